"""The venue as views for Spark SQL, and registered queries written on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrium.functions import route_sql
from atrium.operators import grid
from atrium.operators.search import build_index
from atrium.sources import venue

from . import build, corridors, features, grids, routes, text  # noqa: F401
from .registry import ORACLES, query

#: view -> what it shows: (spark, folder of tables) -> DataFrame
VIEWS = {
    "venue_stands": venue.stands,
    "venue_stand_features": features.features,
    "venue_features": build.map_features_of,
    "venue_index": lambda spark, sf_dir: build_index(build.map_features_of(spark, sf_dir)),
    "venue_grid": grids.cells_to_join,
    "venue_grids": lambda spark, sf_dir: packed_grids(spark, sf_dir),
    "venue_ways": routes.ways,
    "venue_corridor_ways": lambda spark, sf_dir: corridors.named_ways(spark, sf_dir)[0],
    "venue_walks": routes.requests,
    "venue_taps": venue.visitors,
}


def packed_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(venue, grid): each venue's grid as one value."""
    rows = grid.packed(grids.cells(spark, sf_dir), grids.WIDTH, grids.HEIGHT)
    return rows.select("venue", F.struct(F.lit(grids.WIDTH).alias("width"), F.lit(grids.HEIGHT).alias("height"), F.lit(1.0).alias("step"), "bits").alias("grid"))


def register(spark: SparkSession, sf_dir: str, *names: str) -> SparkSession:
    """Registers the named views of VIEWS, or all, and the route functions; returns the session."""
    for name in names or VIEWS:
        VIEWS[name](spark, sf_dir).createOrReplaceTempView(name)
    route_sql.register(spark)
    return spark


@query(ORACLES["stand_area_by_category"])
def sql_stand_area(spark, sf_dir):
    """stand_area_by_category on the views."""
    return register(spark, sf_dir, "venue_stand_features").sql("select kind, cat, count(*) as n, sum(area_m2) as total_m2, avg(area_m2) as mean_m2 from venue_stand_features group by kind, cat")


@query(ORACLES["edge_list"])
def sql_edge_list(spark, sf_dir):
    """edge_list on the views: neighbours meet by equi-joins on the grid."""
    return register(spark, sf_dir, "venue_grid").sql("""
        with free as (select venue, i, j from venue_grid where free),
        steps as (select venue, i, j, di, dj from free lateral view inline(arrays_zip(array(1, -1, 0, 0, 1, 1, -1, -1), array(0, 0, 1, -1, 1, -1, 1, -1))) t as di, dj),
        met as (select s.venue, s.di, s.dj from steps s join free t on t.venue = s.venue and t.i = s.i + s.di and t.j = s.j + s.dj
          left semi join free a on a.venue = s.venue and a.i = s.i + s.di and a.j = s.j left semi join free b on b.venue = s.venue and b.i = s.i and b.j = s.j + s.dj)
        select venue, di, dj, count(*) as n, round(sum(sqrt(cast(di * di + dj * dj as double))), 6) as total from met group by venue, di, dj""")


@query(ORACLES["ways_in_cells"])
def sql_ways(spark, sf_dir):
    """ways_in_cells on the views."""
    return register(spark, sf_dir, "venue_ways").sql("select venue, ord, name, derived, ax, ay, bx, `by`, width from venue_ways")


@query(ORACLES["hit_lookup_last_wins"])
def sql_hit_lookup(spark, sf_dir):
    """hit_lookup_last_wins on the views."""
    return register(spark, sf_dir, "venue_stands").sql("select venue, key, h.k, h.name from (select venue, coalesce(code, name) as key, max_by(struct(k, name), ord) as h from venue_stands group by venue, coalesce(code, name))")


@query()
def sql_route_cost(spark, sf_dir):
    """route_cost on the views: an origin's walks are one search of the table function, or several if there are many."""
    return register(spark, sf_dir, "venue_grids", "venue_walks").sql("""
        with origins as (select venue, ai, aj, ceil(count(*) / 512) as slices from venue_walks group by venue, ai, aj),
        asked as (select w.venue, w.ai, w.aj, collect_list(struct(w.id, w.bi, w.bj)) as ends from venue_walks w join origins o on o.venue = w.venue and o.ai = w.ai and o.aj = w.aj group by w.venue, w.ai, w.aj, pmod(xxhash64(w.id), o.slices))
        select r.id, round(r.cost, 6) as cost, round(r.metres, 3) as metres from asked a join venue_grids g on g.venue = a.venue, lateral routes_from(g.grid, a.ai, a.aj, a.ends) r""")
