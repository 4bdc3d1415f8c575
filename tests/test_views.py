"""The SQL surface: views, table functions and the same rows as the registry."""

import math

import pytest

from atrium.operators.routing import routes
from atrium.plans import grids, views
from atrium.plans.catalogue import QUERIES
from atrium.plans.routes import requests

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql(spark):
    return views.register(spark, SF).sql


def rows(df):
    return sorted(repr(sorted(r.asDict().items())) for r in df.collect())


@pytest.mark.parametrize("name, other", [("sql_stand_area", "stand_area_by_category"), ("sql_ways", "ways_in_cells"), ("sql_hit_lookup", "hit_lookup_last_wins")])
def test_queries_on_views_give_the_registry_rows(spark, name, other):
    assert rows(QUERIES[name](spark, SF)) == rows(QUERIES[other](spark, SF))


def test_routes_by_sql_are_those_of_the_operator(spark):
    want = {r["id"]: (r["cost"], r["metres"]) for r in routes(requests(spark, SF), grids.cells(spark, SF), grids.WIDTH, grids.HEIGHT).collect() if r["cost"] is not None}
    got = {r["id"]: (r["cost"], r["metres"]) for r in QUERIES["sql_route_cost"](spark, SF).collect() if r["cost"] is not None}
    assert got == {n: (round(c, 6), round(m, 3)) for n, (c, m) in want.items()} and len(got) > 500


def test_route_and_simplify_in_lateral_joins(spark, sql):
    walks = sql("select * from venue_walks order by id limit 40")
    walks.createOrReplaceTempView("some_walks")
    cells = sql("select w.id, r.* from some_walks w join venue_grids g on g.venue = w.venue, lateral route(g.grid, w.ai, w.aj, w.bi, w.bj) r").collect()
    ways = {}
    for r in sorted(cells, key=lambda r: (r["id"], r["seq"])):
        ways.setdefault(r["id"], []).append(r)
    for w in walks.collect():
        own = ways.get(w["id"])
        if own:
            assert (own[0]["i"], own[0]["j"]) == (w["ai"], w["aj"]) and (own[-1]["i"], own[-1]["j"]) == (w["bi"], w["bj"])
            assert all(max(abs(p["i"] - q["i"]), abs(p["j"] - q["j"])) == 1 and p["cost"] < q["cost"] for p, q in zip(own, own[1:]))
    short = sql("""with c as (select w.id, any_value(g.grid) as grid, transform(array_sort(collect_list(struct(r.seq, r.i, r.j))), x -> struct(x.i, x.j)) as cells
        from some_walks w join venue_grids g on g.venue = w.venue, lateral route(g.grid, w.ai, w.aj, w.bi, w.bj) r group by w.id) select id, simplify(grid, cells) as corners from c""").collect()
    assert {r["id"]: [(c["i"], c["j"]) for c in r["corners"]] for r in short} == {n: [(c["i"], c["j"]) for c in own if c["corner"]] for n, own in ways.items()} and len(short) > 5
    assert sql("select count(*) from venue_grids g, lateral route(g.grid, null, 1, 2, 2)").first()[0] == 0
    assert sql("select count(*) from venue_grids g, lateral route(g.grid, -1, 1, 2, 2)").first()[0] == 0


def test_upper_median_and_the_other_views(sql):
    assert [r[0] for r in sql("select upper_median(v) from values (array(3D, 1D, 2D, 9D)), (array(5D)), (cast(array() as array<double>)) t(v)").collect()] == [3.0, 5.0, None]
    counts = {v: sql(f"select count(*) from {v}").first()[0] for v in ("venue_features", "venue_index", "venue_corridor_ways", "venue_taps")}
    assert all(n > 0 for n in counts.values()) and not math.isnan(sql("select avg(centre.x) from venue_index").first()[0])


def test_stands_are_dealt(spark):
    """A small file is one task, but the geometry of its parts is long work."""
    from atrium.sources import venue

    assert venue.stands(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_projected_queries_list_nothing_they_broadcast(spark):
    """Rows listed at cells are more than the optimiser takes them for; an area is worked out once, whatever asks for it."""
    from atrium.plans.catalogue import QUERIES

    for name in ("prism_fix", "legacy_lane_synthesis", "names_inside_shapes"):
        assert "BroadcastExchange" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString(), name
    plan = QUERIES["drawing_bbox"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 2


def test_cells_of_the_view_are_not_broadcast(spark):
    """The optimiser knows how many cells the view has: joins of SQL, which can't be given hints, are merged beyond the limit."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")  # the table is small; its cells were taken for a few KB
    try:
        plan = QUERIES["sql_edge_list"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 3 and "BroadcastHashJoin" not in plan
