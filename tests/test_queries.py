"""Every venue query with an oracle against DuckDB, and properties of those without."""

import duckdb
import pytest

from atrium.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_equal_requests_are_told_once(spark, tmp_path, monkeypatch):
    """Steps are those told request by request, but a route that several ask for is told once."""
    from pyspark.sql import functions as F

    from atrium.operators import instructions, routing
    from atrium.plans import grids, routes

    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 300")
    orders.union(orders.withColumn("o_orderkey", F.expr("o_orderkey + 504000"))).write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{SF}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    told, plain_ways = [], instructions.leg_ways
    monkeypatch.setattr(instructions, "leg_ways", lambda legs, *more: told.append(legs.select("route").distinct().count()) or plain_ways(legs, *more))
    steps = QUERIES["instruction_steps"](spark, str(tmp_path))
    got = sorted(map(repr, steps.collect()))
    found = routing.routes(routes.requests(spark, str(tmp_path)), grids.packed(spark, str(tmp_path)), grids.WIDTH, grids.HEIGHT).where("size(cells) > 1")
    assert 0 < told[0] <= found.count() / 2
    parts = found.selectExpr("venue", "id as route", "posexplode(zip_with(slice(cells, 1, size(cells) - 1), slice(cells, 2, size(cells) - 1), (p, q) -> struct(p, q))) as (seq, c)")
    legs = parts.selectExpr("venue", "route", "seq", "route * 1000 + seq as leg", *[f"cast(c.{e}.{c} as double) as {e}{c}" for e in "pq" for c in "ij"])
    named = plain_ways(legs, routes.ways(spark, str(tmp_path))).selectExpr("route", "seq", "qi - pi as dx", "qj - pj as dy", "hypot(qi - pi, qj - pj) as metres", "way", "derived", "concat('Estande ', route) as label")
    want = instructions.instructions(named, handedness=-1).withColumn("metres", F.round("metres", 3))
    assert got == sorted(map(repr, want.select(steps.columns).collect()))


def test_instructions_add_up(spark):
    from pyspark.sql import functions as F

    steps = QUERIES["instruction_steps"](spark, SF)
    per = steps.groupBy("route").agg(F.sum("metres").alias("m"), F.max_by("turn", "seq").alias("last"))
    assert per.where("last <> 'chegada'").isEmpty()
    routes = QUERIES["route_path_metres"](spark, SF).selectExpr("id as route", "metres")
    assert per.join(routes, "route").where("abs(m - metres) > 0.5").isEmpty()
    assert steps.where("turn = 'direita' and text not like '%direita%'").isEmpty()


def test_two_opt_never_longer(spark):
    from atrium.operators import itinerary
    from atrium.plans.routes import short_itineraries

    rows = short_itineraries(spark, SF)
    best, local = itinerary.best_order(rows).withColumnRenamed("metres", "b"), itinerary.two_opt(rows)
    assert best.join(local, "itin").where("metres < b - 1e-6").isEmpty()


def test_session_stream(spark, tmp_path):
    from atrium.streaming.taps import session_counts

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = session_counts(stream, late="1 minute").writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    batch, live = session_counts(events), spark.table("sessions")
    assert live.exceptAll(batch).isEmpty() and live.count() > 0


def test_reachability_and_pieces(spark):
    import random

    from atrium.operators.grid import components, reachable

    rng = random.Random(6)
    free = {(i, j): rng.random() > 0.45 for i in range(18) for j in range(15)}
    cells = spark.createDataFrame([(0, i, j, f) for (i, j), f in free.items()], "venue long, i int, j int, free boolean")
    ok = lambda i, j: free.get((i, j), False)

    def flood(start):
        seen, todo = {start}, [start]
        while todo:
            i, j = todo.pop()
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    t = (i + a, j + b)
                    if t not in seen and ok(*t) and (not (a and b) or ok(i + a, j) and ok(i, j + b)):
                        seen.add(t)
                        todo.append(t)
        return frozenset(seen)

    pieces = {}
    for r in components(cells).collect():
        pieces.setdefault(r["piece"], set()).add((r["i"], r["j"]))
    assert {frozenset(p) for p in pieces.values()} == {flood(c) for c, f in free.items() if f}
    seed = next(c for c, f in free.items() if f)
    got = reachable(cells, spark.createDataFrame([(0, *seed)], "venue long, i int, j int"))
    assert {(r["i"], r["j"]) for r in got.collect()} == flood(seed)


def test_nearest_unused_is_one_greedy_pass(spark):
    from atrium.sources import venue

    s = [r for r in venue.stands(spark, SF).select("k", "venue", "code", "x0", "y0").collect()]
    used, want = set(), []
    for w in sorted((r for r in s if r["k"] % 3 == 0), key=lambda r: r["k"]):
        near = sorted((d, f["code"]) for f in s if f["k"] % 3 == 1 and f["venue"] == w["venue"] and (d := ((f["x0"] - w["x0"]) ** 2 + (f["y0"] - w["y0"]) ** 2) ** 0.5) <= 10)
        code = next((c for _, c in near if (w["venue"], c) not in used), None)
        if code:
            used.add((w["venue"], code))
            want.append((w["venue"], w["k"], code))
    assert sorted(tuple(r) for r in QUERIES["legacy_nearest_unused_code"](spark, SF).select("venue", "ord", "code").collect()) == sorted(want)


def test_a_tail_joins_one_head(spark):
    from atrium.operators.labels import repair_codes

    rows = [(0, 1, "A", 15.5, 10.0, 4.0), (0, 2, "B", 16.5, 10.0, 4.0), (0, 3, "07", 16.0, 12.0, 4.0)]
    out = repair_codes(spark.createDataFrame(rows, "venue long, label_id long, txt string, x double, y double, size double"))
    assert sorted((r["label_id"], r["txt"], r["joined"]) for r in out.collect()) == [(1, "A07", True), (2, "B", False)]


@pytest.mark.parametrize("name", "raster_free_cells access_cells cell_set_ops edge_list grid_bitunpack clearance_at line_of_sight circulation_cells corridor_runs nearest_door".split())
def test_no_table_of_cells_is_broadcast(spark, name):
    """The optimiser takes listed cells for as few as the blocks they were listed from."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    broadcasts = [part for part in plan.split("BroadcastExchange")[1:] if "[i#" in part or "free#" in part or "mx#" in part]
    assert not broadcasts


def test_edges_keep_to_listed_cells(spark):
    from atrium.operators.grid import edges

    rows = [(0, i, j, (i, j) != (1, 1)) for i in range(4) for j in range(3) if (i, j) != (3, 0)]
    free = {(i, j) for _, i, j, f in rows if f}
    want = {(i, j, i + a, j + b) for i, j in free for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (i + a, j + b) in free and (not (a and b) or (i + a, j) in free and (i, j + b) in free)}
    got = [(r["i"], r["j"], r["ti"], r["tj"]) for r in edges(spark.createDataFrame(rows, "venue long, i int, j int, free boolean")).collect()]
    assert len(got) == len(want) and set(got) == want


def test_lines_of_sight_sample_by_sample(spark):
    import math
    import random

    from atrium.operators.routing import visible

    rng = random.Random(3)
    free = {(i, j): rng.random() > 0.15 for i in range(20) for j in range(13)}
    cells = spark.createDataFrame([(0, i, j, f) for (i, j), f in free.items()], "venue long, i int, j int, free boolean")
    lines = [(0, n, *(rng.randrange(-1, 21) if n % 9 == 0 else rng.randrange(13) for _ in range(4))) for n in range(300)]

    def walk(ai, aj, bi, bj):
        n = max(abs(bi - ai), abs(bj - aj))
        at = [(math.floor(ai + (bi - ai) * (s / max(n, 1)) + 0.5), math.floor(aj + (bj - aj) * (s / max(n, 1)) + 0.5)) for s in range(n + 1)]
        return all(free.get(c, False) for c in at), n + 1

    rows = spark.createDataFrame([*lines, (0, 300, None, 1, 2, 3)], "venue long, id long, ai int, aj int, bi int, bj int")
    got = {r["id"]: (r["visible"], r["samples"]) for r in visible(rows, cells, 20, 13).collect()}
    assert got == {line[1]: walk(*line[2:]) for line in lines}


def test_pieces_take_no_rounds_of_jobs(spark):
    """Pieces come out of one pass over the venues; a spiral, whose label takes long ways, and a corner that shuts are labelled right."""
    from atrium.operators.grid import components

    rows = ["#########", ".......##", "######.##", "#####.#.#", ".....#..#", "##.######", "..#.....#"]
    cells = [(v, i - 3, j + 5, c == ".") for v in (0, 1) for j, line in enumerate(rows) for i, c in enumerate(line if v == 0 else line[::-1])]
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("pieces", "pieces")
    got = components(spark.createDataFrame(cells, "venue long, i int, j int, free boolean")).collect()
    assert len(tracker.getJobIdsForGroup("pieces")) <= 2
    sc.setLocalProperty("spark.jobGroup.id", None)
    free = {(v, i, j) for v, i, j, f in cells if f}
    want = {}
    for start in sorted(free, key=lambda c: (c[0], c[2], c[1])):
        todo = [start] if start not in want else []
        while todo:
            v, i, j = at = todo.pop()
            if at not in want:
                want[at] = start[2] * 1000000 + start[1]
                for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)):  # a diagonal needs both cells beside it, so it adds nothing
                    todo += [(v, i + a, j + b)] if (v, i + a, j + b) in free else []
    assert {(r.venue, r.i, r.j): r.piece for r in got} == want


def test_unpacked_grids_are_cut_before_they_are_listed(spark):
    """No row of a listed grid carries the grid's string: what is exploded last is an octet's."""
    from atrium.operators.grid import unpack_bits

    packed = spark.createDataFrame([(7, "qsA=")], "venue long, bits string")  # 10101010 11000000
    out = unpack_bits(packed, 5, 3)
    assert [(r.venue, r.i, r.j, r.free) for r in out.orderBy("j", "i").collect()] == [(7, n % 5, n // 5, c == "1") for n, c in enumerate("101010101100000")]
    generators = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line]
    assert len(generators) == 2 and not any("unbase64" in line or "[bits" in line for line in generators[:1])


def test_coverage_takes_roots_as_sql_does(spark):
    """Samples just on a way's edge: hypot rounds some beyond it, the statement's root of squares doesn't."""
    import math
    import random

    from atrium.operators.instructions import with_coverage

    rng, rows = random.Random(1), []
    while len(rows) < 200:
        x, y = rng.uniform(4, 100), rng.uniform(4, 100)
        edge = math.sqrt(x * x + y * y)
        if edge < math.hypot(x, y) and 2 * (edge - 3) / 2 + 3 == edge:
            rows.append((x, y, x, y, 0.0, 0.0, 0.0, 0.0, 2 * (edge - 3)))
    ways = spark.createDataFrame(rows, "pi double, pj double, qi double, qj double, ax double, ay double, bx double, by double, width double")
    assert with_coverage(ways).where("cov < 1").isEmpty()
