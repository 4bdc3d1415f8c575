"""Routes as SQL functions: table functions that search a packed grid, and a vectorised simplification.

A grid is one value, struct<width, height, step, bits>, as the view venue_grids holds it; rows reach
their grid by a join, so nothing is sent to all executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atrium import params
from atrium.operators.grid import unpacked
from atrium.operators.routing import Grid, length

CELLS = "array<struct<i:int,j:int>>"
#: The same type where no session may parse it yet.
CELLS_TYPE = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))


class KeptGrid:
    """The Grid of a packed value; the last one is kept, since rows of one venue mostly follow each other."""

    def __init__(self):
        self.bits, self.grid = None, None

    def of(self, value) -> Grid:
        if self.bits != (now := bytes(value["bits"])):
            self.bits, self.grid = now, Grid(unpacked(now, value["width"], value["height"]), params.COMFORT_M / value["step"])
        return self.grid


@F.udtf(returnType="seq int, i int, j int, cost double, corner boolean")
class Route:
    """route(grid, ai, aj, bi, bj): the cells of the cheapest way between two cells, in order, with the cost so far and
    whether the cell is a corner of the simplified route. No rows where there is no way or an argument is null."""

    def __init__(self):
        self.kept = KeptGrid()

    def eval(self, grid, ai: int, aj: int, bi: int, bj: int) -> Iterator[tuple]:
        if None in (grid, ai, aj, bi, bj):
            return
        g = self.kept.of(grid)
        if g.number((ai, aj)) < 0 or g.number((bi, bj)) < 0:
            return
        cost, _ = g.spread([(ai, aj)], [(bi, bj)])
        if cost[g.number((bi, bj))] < math.inf:
            way = g.way(cost, (bi, bj))
            corners = set(g.simplify(way))
            for n, cell in enumerate(way):
                yield n, *cell, cost[g.number(cell)], cell in corners


@F.udtf(returnType=f"id long, cost double, metres double, cells {CELLS}")
class RoutesFrom:
    """routes_from(grid, ai, aj, ends): the simplified route to each of ends, an array of struct<id, bi, bj>, by one
    search; nulls where there is no way."""

    def __init__(self):
        self.kept = KeptGrid()

    def eval(self, grid, ai: int, aj: int, ends: list) -> Iterator[tuple]:
        if None in (grid, ai, aj, ends):
            return
        g = self.kept.of(grid)
        found = g.search((ai, aj), [(e["bi"], e["bj"]) for e in ends])
        short = {b: g.simplify(way) for b, (_, way) in found.items()}
        for e in ends:
            b = (e["bi"], e["bj"])
            yield (e["id"], found[b][0], length(short[b], grid["step"]), [{"i": i, "j": j} for i, j in short[b]]) if b in found else (e["id"], None, None, None)


@F.pandas_udf(CELLS_TYPE)
def simplify(grid: pd.DataFrame, cells: pd.Series) -> pd.Series:
    """simplify(grid, cells): the corners of a way of neighbouring cells; null stays null."""
    kept = KeptGrid()
    rows = zip(grid.to_dict("records"), cells)
    return pd.Series([None if c is None or g["bits"] is None else [{"i": i, "j": j} for i, j in kept.of(g).simplify([(p["i"], p["j"]) for p in c])] for g, c in rows], dtype=object)


def register(spark: SparkSession) -> None:
    """Makes route, routes_from, simplify and upper_median callable from the session's SQL."""
    spark.udtf.register("route", Route)
    spark.udtf.register("routes_from", RoutesFrom)
    spark.udf.register("simplify", simplify)
    spark.sql("create or replace temporary function upper_median(v array<double>) returns double comment 'The upper of two middle values' return get(array_sort(v), size(v) div 2)")
