"""Queries on coordinate frames and orientation."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium.functions import geometry as geo
from atrium.operators import frames
from atrium.sources import venue
from atrium.sources.venue import STANDS_SQL

from .registry import query

#: Corners of a made-up building: the first side, its start and the ring's western end on it.
RING = [(-46.6372, -23.5155), (-46.6347, -23.5157), (-46.6349, -23.5177), (-46.6381, -23.5175), (-46.6379, -23.51545)]
_GEO = f"""g as (select {RING[0][1]}::double as lat0, {RING[0][0]}::double as lon0, {RING[1][0]}::double as lon1, {RING[1][1]}::double as lat1),
h as (select *, 111320.0 as mlat, 111320.0 * cos(radians(lat0)) as mlon from g),
i as (select *, (lon1 - lon0) * mlon as dx, (lat1 - lat0) * mlat as dy from h),
u as (select *, dx / sqrt(dx * dx + dy * dy) as ux, dy / sqrt(dx * dx + dy * dy) as uy from i),
p as (select unnest([{', '.join(f'{{x: {x}::double, y: {y}::double}}' for x, y in RING)}]) as p),
w as (select min(((p.x - lon0) * mlon) * ux + ((p.y - lat0) * mlat) * uy) as west from p, u where abs(((p.x - lon0) * mlon) * uy - ((p.y - lat0) * mlat) * ux) < 5),
a as (select lon0 + west * ux / mlon as lon, lat0 + west * uy / mlat as lat, ux, uy, mlon, mlat from u, w)"""


@query(f"""with {STANDS_SQL}, b as (select venue, min(x0) as ox, min(y0) as oy, max(x1) - min(x0) as w, max(y1) - min(y0) as d from stands group by venue)
select k, w - (x0 - ox) as x, d - (y0 - oy) as y, x0 as back_x, y0 as back_y from stands join b using (venue)""")
def frame_rotate(spark, sf_dir):
    """Half a turn of each venue inside its own box, and back."""
    s = venue.stands(spark, sf_dir)
    box = s.groupBy("venue").agg(F.min("x0").alias("ox"), F.min("y0").alias("oy"), (F.max("x1") - F.min("x0")).alias("w"), (F.max("y1") - F.min("y0")).alias("d"))
    x, y = frames.half_turn("x0", "y0")
    rows = s.join(box, "venue").withColumns({"x": x, "y": y})
    bx, by = frames.half_turn_back("x", "y")
    return rows.select("k", "x", "y", bx.alias("back_x"), by.alias("back_y"))


@query(f"""with {STANDS_SQL}, {_GEO}
select k, round(lon + (x0 * ux + y0 * uy) / mlon, 7) as lng, round(lat + (x0 * uy - y0 * ux) / mlat, 7) as lat from stands, (select lon, lat, ux, uy, mlon, mlat from a)""")
def frame_lnglat(spark, sf_dir):
    """Metres of the building to longitude and latitude."""
    geo_ref = frames.georeference(RING)
    lng, lat = frames.to_lnglat("x0", "y0", geo_ref)
    return venue.stands(spark, sf_dir).select("k", F.round(lng, 7).alias("lng"), F.round(lat, 7).alias("lat"))


@query(f"""with {STANDS_SQL}
select k, round(((lng + 46.63) * 4e-6 - (lat + 23.51) * -1e-6) / (5e-6 * 4e-6 - 1e-6 * -1e-6), 6) as i, round((5e-6 * (lat + 23.51) - 1e-6 * (lng + 46.63)) / (5e-6 * 4e-6 - 1e-6 * -1e-6), 6) as j, 1 as handedness
from (select k, -46.63 + x0 * 5e-6 + y0 * -1e-6 as lng, -23.51 + x0 * 1e-6 + y0 * 4e-6 as lat from stands)""")
def frame_cell_inverse(spark, sf_dir):
    """Longitude and latitude to fractional cells, and the frame's handedness."""
    grid = frames.GridFrame(origin=(-46.63, -23.51), ex=(5e-6, 1e-6), ey=(-1e-6, 4e-6))
    rows = venue.stands(spark, sf_dir).selectExpr("k", "-46.63D + x0 * 5e-6D + y0 * -1e-6D as lng", "-23.51D + x0 * 1e-6D + y0 * 4e-6D as lat")
    i, j = grid.to_cell("lng", "lat")
    return rows.select("k", F.round(i, 6).alias("i"), F.round(j, 6).alias("j"), grid.handedness().cast("int").alias("handedness"))


@query(f"""with {STANDS_SQL}, t as (select k, (x1 - x0 + k % 3)::double as w, (y1 - y0 + k % 4)::double as h, ((k * 47) % 1000 - 500)::double as a, (300 + k % 7 * 100)::double as sw, (k % 5 * 200)::double as sh from stands),
u as (select *, w * cos(radians(h / 2)) as wide from t), z as (select *, least(sw / wide, sh / h) as lying, least(sw / h, sh / wide) as standing from u), c as (select unnest([1, 2, 3, 4]) as "case", unnest([1, -1, 1, -1]) as sx, unnest([1, 1, -1, -1]) as sy)
select k, "case", sx * w as vx, sy * h as vy, case when sw > 0 and sh > 0 and standing > lying then 94.0 else 4.0 end::double as bearing, case when a % 360 > 180 then a % 360 - 360 when a % 360 <= -180 then a % 360 + 360 else a % 360 end as wrapped from z, c""")
def orientation_fit(spark, sf_dir):
    """The bearing that shows a box larger on a screen, wrapped angles and the four mirrorings of a shape."""
    rows = venue.stands(spark, sf_dir).selectExpr("k", "cast(x1 - x0 + k % 3 as double) as w", "cast(y1 - y0 + k % 4 as double) as h", "cast((k * 47) % 1000 - 500 as double) as a", "cast(300 + k % 7 * 100 as double) as sw", "cast(k % 5 * 200 as double) as sh")
    rows = rows.withColumn("box", F.struct(F.lit(0.0).alias("west"), F.lit(0.0).alias("south"), F.col("w").alias("east"), F.col("h").alias("north")))
    rows = rows.select("*", F.explode(F.expr("array(struct(1 as c, 1 as sx, 1 as sy), struct(2 as c, -1 as sx, 1 as sy), struct(3 as c, 1 as sx, -1 as sy), struct(4 as c, -1 as sx, -1 as sy))")).alias("m"))
    return rows.select("k", F.col("m.c").alias("case"), (F.col("m.sx") * F.col("w")).alias("vx"), (F.col("m.sy") * F.col("h")).alias("vy"), frames.best_bearing("sw", "sh", "box", 4.0).alias("bearing"), geo.wrap_degrees("a").alias("wrapped"))


@query(f"""with {STANDS_SQL}, c as (select venue, -46.6 + x0 * 1e-5 as w, -46.6 + x1 * 1e-5 as e, -23.5 + y0 * 1e-5 as s, -23.5 + y1 * 1e-5 as n from stands where k % 9 <> 0)
select venue, round(min(w), 9) as west, round(min(s), 9) as south, round(max(e), 9) as east, round(max(n), 9) as north from c group by venue""")
def coordinate_boxes(spark, sf_dir):
    """The box of each venue's nested coordinates; shapes without any give none."""
    s = venue.stands(spark, sf_dir).selectExpr("venue", "k", "-46.6D + x0 * 1e-5D as w", "-46.6D + x1 * 1e-5D as e", "-23.5D + y0 * 1e-5D as s", "-23.5D + y1 * 1e-5D as n")
    text = F.expr("case when k % 9 = 0 then '[]' when k % 2 = 0 then concat('[[[', w, ',', s, '],[', e, ', ', n, ']]]') else concat('[[', w, ',', n, '],[', e, ',', s, ']]') end")
    box = s.withColumn("b", geo.coordinate_box(text)).groupBy("venue").agg(F.min("b.west").alias("west"), F.min("b.south").alias("south"), F.max("b.east").alias("east"), F.max("b.north").alias("north"))
    return box.select("venue", *[F.round(c, 9).alias(c) for c in ("west", "south", "east", "north")])


@query(f"""with {STANDS_SQL} select k, round((x0 - 30.0) * 0.194875, 3) as mx, round((y0 - 105.0) * 0.194875, 3) as my, round(x0, 6) as back_x, round(y0, 6) as back_y from stands""")
def frame_page(spark, sf_dir):
    """Page points to metres of the drawing, and places on the globe back to the building."""
    s = venue.stands(spark, sf_dir)
    mx, my = frames.page_to_metres("x0", "y0", 30.0, 105.0)
    at = frames.georeference(RING)
    lng, lat = frames.to_lnglat("x0", "y0", at)
    rows = s.withColumns({"lng": lng, "lat": lat})
    bx, by = frames.from_lnglat("lng", "lat", at)
    return rows.select("k", mx.alias("mx"), my.alias("my"), F.round(bx, 6).alias("back_x"), F.round(by, 6).alias("back_y"))


@query("""with l as (select l_orderkey, (l_partkey % 140)::double as x, (l_suppkey * 7 % 90)::double as y, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos from lineitem),
d as (select l_orderkey, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) as s from l window w as (partition by l_orderkey order by pos))
select l_orderkey, round(0.5 * coalesce(sum(s), 0), 6) as metres from d group by l_orderkey""")
def polyline_length(spark, sf_dir):
    """Length of each order's walk over its lines, in steps of half a metre."""
    rows = venue.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast(l_partkey % 140 as double) as x, cast(l_suppkey * 7 % 90 as double) as y) as s")
    walks = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("p"))
    return walks.select("l_orderkey", F.round(0.5 * geo.path_length(F.transform("p", lambda s: geo.point(s["x"], s["y"]))), 6).alias("metres"))
