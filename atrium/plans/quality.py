"""Queries on a map's quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium.functions import geometry as geo
from atrium.operators import corridors, quality
from atrium.operators.grid import components, stored, work_path
from atrium.sources import venue
from atrium.sources.venue import DOORS_SQL, STANDS_SQL

from . import corridors as lanes
from .features import FEATURES_SQL, features
from .grids import CELLS_SQL, cells
from .registry import query

_MODEL = """model as (select venue, k * 2 as mord, x0 + (k % 7) * 0.02 as x0, y0 as y0, case when k % 23 = 5 then x0 + 2 else x1 end + (k % 7) * 0.02 as x1, y1 + case when k % 11 = 0 then 1.0 else 0 end as y1 from features where k % 19 <> 0
  union all select venue, k * 2 + 1, x0 + 2 + (k % 7) * 0.02, y0, x1 + (k % 7) * 0.02, y1 + case when k % 11 = 0 then 1.0 else 0 end from features where k % 19 <> 0 and k % 23 = 5),
pairs as (select f.k, f.cat, mord, greatest(0, least(f.x1, m.x1) - greatest(f.x0, m.x0)) * greatest(0, least(f.y1, m.y1) - greatest(f.y0, m.y0)) as i, (m.x1 - m.x0) * (m.y1 - m.y0) as a, (f.x1 - f.x0) * (f.y1 - f.y0) as e,
  sqrt(power((m.x0 + m.x1 - f.x0 - f.x1) / 2, 2) + power((m.y0 + m.y1 - f.y0 - f.y1) / 2, 2)) as drift, (m.x0 + m.x1) / 2 as mx, (m.y0 + m.y1) / 2 as my, (f.x0 + f.x1) / 2 as cx, (f.y0 + f.y1) / 2 as cy, f.x0, f.y0, f.x1, f.y1
  from features f join model m on m.venue = f.venue and m.x0 < f.x1 and m.x1 > f.x0 and m.y0 < f.y1 and m.y1 > f.y0),
one as (select *, i / (e + a - i) as iou, row_number() over (partition by k order by i / (e + a - i) desc, mord) as n from pairs),
many as (select k, sum(i) / (min(e) + sum(a) - sum(i)) as iou, sqrt(power(sum(mx * a) / sum(a) - min(cx), 2) + power(sum(my * a) / sum(a) - min(cy), 2)) as drift from pairs where mx > x0 and mx < x1 and my > y0 and my < y1 group by k),
best as (select o.k, case when o.iou < 0.98 and m.iou > o.iou then m.iou else o.iou end as iou, case when o.iou < 0.98 and m.iou > o.iou then m.drift else o.drift end as drift from one o left join many m on m.k = o.k where o.n = 1)"""


@query(f"""with {FEATURES_SQL}, {_MODEL}
select f.cat as category, count(*) as total, sum(case when iou >= 0.98 then 1 else 0 end)::bigint as faithful, round(sum(case when iou >= 0.98 then 1 else 0 end) / count(*), 4)::double as ratio, round(max(drift) * 100, 2) as drift_cm
from features f left join best b on b.k = f.k group by f.cat""")
def iou_match(spark, sf_dir):
    """Fidelity by category of a drifted model, some of whose shapes are missing, grown or cut in two."""
    f = features(spark, sf_dir)
    at = lambda mord, x0, x1: f.where("k % 19 <> 0").selectExpr("k", "venue", f"{mord} as mord", f"{x0} + (k % 7) * 0.02D as x0", "y0", f"{x1} + (k % 7) * 0.02D as x1", "y1 + case when k % 11 = 0 then 1.0D else 0D end as y1")
    model = at("k * 2", "x0", "case when k % 23 = 5 then x0 + 2 else x1 end").union(at("k * 2 + 1", "x0 + 2", "x1").where("k % 23 = 5")).drop("k")
    expected = f.selectExpr("venue", "k as ord", "cat as category", "x0", "y0", "x1", "y1")
    return quality.fidelity(quality.iou_with_parts(quality.iou_match(expected, model), model))


_LINES = """lines as (select k as ord, venue, case when k % 2 = 0 then x0 - 1 else x0 + 2 end as ax, case when k % 2 = 0 then case when k % 3 = 0 then y0 + 3 else y0 - 1 end else y0 - 1 end as ay,
  case when k % 2 = 0 then x0 + k % 8 else x0 + 2 end as bx, case when k % 2 = 0 then case when k % 3 = 0 then y0 + 3 else y0 - 1 end else y0 - 1 + k % 5 end as "by" from stands where col % 5 = 0)"""


@query(f"""with {STANDS_SQL}, {_LINES}
select distinct l.venue, l.ord from lines l join stands b on b.venue = l.venue and least(greatest(ax, bx), b.x1 - 0.3) >= greatest(least(ax, bx), b.x0 + 0.3) and least(greatest(ay, "by"), b.y1 - 0.3) >= greatest(least(ay, "by"), b.y0 + 0.3)
where greatest(least(greatest(ax, bx), b.x1 - 0.3) - greatest(least(ax, bx), b.x0 + 0.3), least(greatest(ay, "by"), b.y1 - 0.3) - greatest(least(ay, "by"), b.y0 + 0.3)) > 0.5""")
def way_crosses_block(spark, sf_dir):
    s = venue.stands(spark, sf_dir)
    lines = s.where("col % 5 = 0").selectExpr("venue", "k as ord", "case when k % 2 = 0 then x0 - 1 else x0 + 2 end as ax", "case when k % 2 = 0 then case when k % 3 = 0 then y0 + 3 else y0 - 1 end else y0 - 1 end as ay",
                                              "case when k % 2 = 0 then x0 + k % 8 else x0 + 2 end as bx", "case when k % 2 = 0 then case when k % 3 = 0 then y0 + 3 else y0 - 1 end else y0 - 1 + k % 5 end as `by`")
    return quality.crossing_blocks(lines, s)


@query(f"""with {STANDS_SQL}, c as (select venue, 0.0 as x0, y1 + case when "row" % 7 = 3 then 1.0 else 0.5 end as y0, 60.0 as x1, y1 + 3.5 as y1 from stands where col = 0)
select venue, k as ord from stands b where not exists (select 1 from c where c.venue = b.venue and power(greatest(c.x0 - b.x1, b.x0 - c.x1, 0), 2) + power(greatest(c.y0 - b.y1, b.y0 - c.y1, 0), 2) <= 0.36)""")
def block_isolated(spark, sf_dir):
    """Stands that touch no corridor: those east of the corridors' end, or set back from theirs."""
    s = venue.stands(spark, sf_dir)
    corridors = s.where("col = 0").selectExpr("venue", "0D as x0", "y1 + case when row % 7 = 3 then 1.0D else 0.5D end as y0", "60D as x1", "y1 + 3.5D as y1")
    return quality.untouched_blocks(s.withColumn("ord", F.col("k")).select("venue", "ord", "x0", "y0", "x1", "y1"), corridors).select("venue", "ord")


#: Ways on a slant through the rows, two lines each, and blocks with their corners cut off.
_SLANTED = """ways as (select venue, "row" as ord, part, case part when 0 then 2.0 else 60.0 end + "row" % 5 as ax, y1 + 0.5 + "row" % 3 as ay, case part when 0 then 30.0 else 61.0 end + "row" % 5 * 2 as bx, y1 - 2.0 + "row" % 9 * 0.8 as "by" from stands, range(2) p(part) where col = 0),
corners as (select k, venue, c, case c when 0 then x0 + 1 when 1 then x1 - 1 when 2 then x1 when 3 then x1 when 4 then x1 - 1 when 5 then x0 + 1 else x0 end as x, case c when 0 then y0 when 1 then y0 when 2 then y0 + 2 when 3 then y1 - 1 when 4 then y1 when 5 then y1 when 6 then y1 - 1 else y0 + 2 end as y from stands, range(8) r(c)),
sides as (select a.k, a.venue, a.x as px, a.y as py, b.x - a.x as dx, b.y - a.y as dy from corners a join corners b on b.k = a.k and b.c = (a.c + 1) % 8)"""


@query(f"""with {STANDS_SQL}, {_SLANTED},
near as (select w.*, s.k from ways w join stands s on s.venue = w.venue and s.x0 <= greatest(ax, bx) and s.x1 >= least(ax, bx) and s.y0 <= greatest(ay, "by") and s.y1 >= least(ay, "by")),
h as (select venue, ord, part, k, ax, ay, bx, "by", (dx * (ay - py) - dy * (ax - px)) / sqrt(dx * dx + dy * dy) - 0.3 as a, (dx * ("by" - py) - dy * (bx - px)) / sqrt(dx * dx + dy * dy) - 0.3 as b from near n join sides s using (venue, k)),
t as (select venue, ord, k, part, max(case when a < 0 and b < 0 then 9 when a < 0 then a / (a - b) else 0 end) as low, min(case when a >= 0 and b < 0 then a / (a - b) else 1 end) as high, max(sqrt(power(bx - ax, 2) + power("by" - ay, 2))) as m from h group by all),
c as (select venue, ord, k, sum(greatest(0, high - low) * m) as m from t group by all)
select distinct venue, ord from c where m > 0.5""")
def slanted_way_crosses_block(spark, sf_dir):
    """Ways on a slant against eight-sided blocks less their rim."""
    s = venue.stands(spark, sf_dir)
    start = "case part when 0 then 2D else 60D end + row % 5"
    ways = s.where("col = 0").withColumn("part", F.explode(F.array(F.lit(0), F.lit(1)))).selectExpr("venue", "row as ord", f"{start} as ax", "y1 + 0.5D + row % 3 as ay", "case part when 0 then 30D else 61D end + row % 5 * 2 as bx", "y1 - 2D + row % 9 * 0.8D as `by`")
    at = lambda x, y: geo.point(F.expr(x), F.expr(y))
    ring = F.array(at("x0 + 1", "y0"), at("x1 - 1", "y0"), at("x1", "y0 + 2"), at("x1", "y1 - 1"), at("x1 - 1", "y1"), at("x0 + 1", "y1"), at("x0", "y1 - 1"), at("x0", "y0 + 2"))
    return quality.crossing_blocks(ways, s.select("venue", ring.alias("ring")))


def buildings(spark, sf_dir):
    """(venue, ring) of each venue's building, written as GeoJSON and read again as the building's document: west a roof
    that runs down on a slant, east a wing as far as the venue's stands."""
    from atrium.sources import documents

    east = venue.stands(spark, sf_dir).groupBy("venue").agg(F.max("x1").alias("e"))
    at = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    ring = F.array(at("7D", "0D"), at("e - 20", "0D"), at("e - 20", "300D"), at("60D", "300D"), at("60D", "536D"), at("7D", "960D"), at("7D", "0D"))
    rows = east.select(F.col("venue").cast("int").alias("ord"), F.lit("predio").alias("kind"), F.col("venue").cast("string").alias("name"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("lines")).alias("geometry"))
    path = work_path(spark, "buildings")
    documents.write_geojson(rows, path)
    return documents.read_rings(spark, path).select(F.col("name").cast("long").alias("venue"), "ring")


#: Below the slanted roof the area of a box is an integral of the roof's height cut to the box: a square over twice the slope.
@query(f"""with {STANDS_SQL}, b as (select *, max(x1) over (partition by venue) - 20 as e from stands),
w as (select k, x0, x1, y0, y1, greatest(x0, 7.0) as l, least(x1, 60.0) as r, greatest(0, least(x1, e) - greatest(x0, 60.0)) * greatest(0, least(y1, 300.0) - greatest(y0, 0.0)) as wing from b),
u as (select *, 960 - 8 * (l - 7) as hl, 960 - 8 * (r - 7) as hr from w),
i as (select k, wing + case when r > l then (power(greatest(hl - y0, 0), 2) - power(greatest(hr - y0, 0), 2) - power(greatest(hl - y1, 0), 2) + power(greatest(hr - y1, 0), 2)) / 16 else 0 end as inner_m2 from u)
select k, round(36.0 - inner_m2, 9)::double as outside_m2, round(100 * (36.0 - inner_m2) / 36.0, 1)::double as share from i where 36.0 - inner_m2 > 0.5""")
def outside_building(spark, sf_dir):
    return quality.outside_building(venue.stands(spark, sf_dir), buildings(spark, sf_dir)).select("k", "outside_m2", "share")


_SIDES = """sides as (select k, 'x' as axis, (x1 - x0 + k % 3) / 1.02 as length from stands union all select k, 'y', (y1 - y0 + k % 4) / 0.98 from stands)"""


def sides(spark, sf_dir):
    s = venue.stands(spark, sf_dir)
    return s.selectExpr("k", "'x' as axis", "(x1 - x0 + k % 3) / 1.02D as length").union(s.selectExpr("k", "'y'", "(y1 - y0 + k % 4) / 0.98D"))


def _sweep(low, n, step, by):
    g = f"{by}, " if by else ""
    return f"""with {STANDS_SQL}, {_SIDES}, c as (select {g}length, count(*) as n from sides group by all), s as (select {low}::double + i * {step}::double as s from range({n}) t(i)),
d as (select {g}s, round(sum(least(length * s % 1, 1 - length * s % 1) * n) / sum(n), 9) as dev from c, s group by all), r as (select *, row_number() over ({'partition by ' + by if by else ''} order by dev, s) as n from d)
select {g}round(s, 6) as s, dev from r where n = 1"""


@query(_sweep(0.9, 2001, 0.0001, ""))
def scale_sweep(spark, sf_dir):
    out = quality.scale_sweep(sides(spark, sf_dir).where("length > 0.5 and length < 40"), 0.9, 1.1, 0.0001)
    return out.select(F.round("s", 6).alias("s"), "dev")


@query(_sweep(0.9, 1001, 0.0002, "axis"))
def axis_sweep(spark, sf_dir):
    """The scale of each axis: an anisotropic drawing has two."""
    out = quality.scale_sweep(sides(spark, sf_dir), 0.9, 1.1, 0.0002, by=("axis",))
    return out.select("axis", F.round("s", 6).alias("s"), "dev")


_AXES = f"""with {STANDS_SQL}, {_SIDES}, c as (select axis, length, count(*) as n from sides group by all), s as (select 0.9::double + i * 0.0002::double as s from range(1001) t(i)),
d as (select axis, s, round(sum(least(length * s % 1, 1 - length * s % 1) * n) / sum(n), 9) as dev from c, s group by all), r as (select *, row_number() over (partition by axis order by dev, s) as n from d),
b as (select max(case when axis = 'x' then s end) as sx, max(case when axis = 'y' then s end) as sy from r where n = 1)"""


@query(f"{_AXES} select round(sx, 6) as sx, round(sy, 6) as sy, round(sy / sx, 6) as ratio, abs(sy / sx - 1) <= 0.05 as isotropic from b")
def isotropy(spark, sf_dir):
    """Whether both axes have one scale."""
    out = quality.isotropy(quality.scale_sweep(sides(spark, sf_dir), 0.9, 1.1, 0.0002, by=("axis",)))
    return out.select(*[F.round(c, 6).alias(c) for c in ("sx", "sy", "ratio")], "isotropic")


@query(f"""with {STANDS_SQL}, {_SIDES}, t as (select length, draw, [0, 0, 0, 1, 1, 1, 2, 3][(instr('0123456789abcdef', substr(md5(k || ':' || draw), 1, 1)) - 1) % 8 + 1] as times from sides, range(1, 61) z(draw)),
c as (select draw, length, sum(times) as n from t where times > 0 group by all), s as (select 0.95::double + i * 0.001::double as s from range(101) t(i)),
d as (select draw, s, round(sum(least(length * s % 1, 1 - length * s % 1) * n) / sum(n), 9) as dev from c, s group by all), r as (select *, row_number() over (partition by draw order by dev, s) as nth from d),
v as (select list_sort(list(s)) as v from r where nth = 1)
select round(v[4], 6) as low, round(v[31], 6) as middle, round(v[-4], 6) as high from v""")
def bootstrap_ci(spark, sf_dir):
    """Middle and ends (4th and 4th last) of the best scale of 60 resamples."""
    draws = quality.scale_sweep(quality.resamples(sides(spark, sf_dir), 60), 0.95, 1.05, 0.001, by=("draw",), times="times")
    ranked = draws.agg(F.array_sort(F.collect_list("s")).alias("v"))  # 60 values
    return ranked.select(F.round(F.element_at("v", 4), 6).alias("low"), F.round(F.element_at("v", 31), 6).alias("middle"), F.round(F.element_at("v", -4), 6).alias("high"))


@query(f"""with {STANDS_SQL}, c as (select venue, "row" as ord, min(x0) as x0, min(y0) as y0, max(x1) - ("row" * 7 % 40) as x1, max(y1) as y1 from stands group by venue, "row"), r as (select *, row_number() over (partition by venue order by x1 - x0 desc, ord) as n from c)
select venue, ord, x0, y0, x1::double as x1, y1 from r where n = 1""")
def largest_canopy(spark, sf_dir):
    """The widest canopy of each venue."""
    rows = venue.stands(spark, sf_dir).groupBy("venue", F.col("row").alias("ord")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return quality.largest_canopy(rows.withColumn("x1", F.expr("x1 - (ord * 7 % 40)")))


_COVER = f"""{CELLS_SQL}, m as (select unnest([0, 1, 2, 4]) as margin), c as (select venue, i, j, cx, cy from cells where free),
g as (select margin, count(*) as n, count(*) filter (where abs((cy - 12) % 10) <= 1.5 + margin or abs((cy - 12) % 10) >= 8.5 - margin or abs(cx - 36) <= 1.5 + margin) as covered from c, m group by margin)"""


@query(f"with {_COVER} select margin, round(covered / n, 6)::double as share from g")
def corridor_coverage(spark, sf_dir):
    """Share of the walkable cells that lie in a corridor's band, at four margins."""
    free = cells(spark, sf_dir).where("free").withColumn("margin", F.explode(F.array(*[F.lit(x) for x in (0, 1, 2, 4)])))
    band = "abs((cy - 12) % 10) <= 1.5D + margin or abs((cy - 12) % 10) >= 8.5D - margin or abs(cx - 36) <= 1.5D + margin"
    return free.groupBy("margin").agg(F.round(F.avg(F.when(F.expr(band), 1.0).otherwise(0.0)), 6).alias("share"))


def _pieces(open_: str) -> str:
    """The connected pieces of a relation of cells: the smallest run without one above it spreads over runs of
    neighbouring lines that share a column. ``big`` has the twelve largest of a venue of at least 20 cells."""
    return f"""isle as (select venue, i, j, i - row_number() over (partition by venue, j order by i) as g from {open_}),
run as materialized (select venue, j, min(i) as lo, max(i) as hi, j::bigint * 1000000 + min(i) as id from isle group by venue, j, g),
above as materialized (select a.venue, a.id, b.id as other from run a join run b on b.venue = a.venue and b.j = a.j + 1 where a.lo <= b.hi and b.lo <= a.hi),
meet as materialized (select * from above union all select venue, other, id from above),
mark(venue, id, label) using key (venue, id) as (select venue, id, id from run where not exists (select 1 from above where above.venue = run.venue and other = run.id)
  union (select t.venue, t.other, min(m.label) from mark m join meet t on t.venue = m.venue and t.id = m.id left join recurring.mark r on r.venue = t.venue and r.id = t.other where r.label is null or m.label < r.label group by t.venue, t.other)),
whole as (select r.venue, m.label, sum(hi - lo + 1)::bigint as area, min(lo) as i0, max(hi) as i1, min(j) as j0, max(j) as j1 from run r join mark m on m.venue = r.venue and m.id = r.id group by all),
big as (select *, row_number() over (partition by venue order by area desc, label) as nth from whole where area >= 20 qualify nth <= 12)"""


def largest_pieces(rest, least: int = 20, most: int = 12):
    """(venue, area, i0, i1, j0, j1) of each venue's ``most`` largest connected pieces of cells (free), of at least ``least``."""
    pieces = components(rest)
    size = pieces.groupBy("venue", "piece").agg(F.count("*").alias("area"), F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    size = size.where(F.col("area") >= least).selectExpr("*", "row_number() over (partition by venue order by area desc, piece) as nth")
    return size.where(F.col("nth") <= most).select("venue", "area", "i0", "i1", "j0", "j1")


@query(f"""with recursive {CELLS_SQL}, rest as (select venue, i, j from cells where free and not (j % 10 between 0 and 1 and i > 30)), {_pieces("rest")}
select venue, area, i0, i1, j0, j1 from big""")
def uncovered_pieces(spark, sf_dir):
    """Of the connected pieces of at least 20 cells that no band covers each venue's twelve largest."""
    return largest_pieces(stored(cells(spark, sf_dir).withColumn("free", F.expr("free and not (j % 10 between 0 and 1 and i > 30)")), "uncovered"))


@query(f"""with recursive {lanes._CORRIDOR}, {lanes._RUNS}, {lanes._TRACKS}, lane as (select p.venue, p.axis, p.centre, p.w, p.plo, p.phi from pieces p join ways w on w.venue = p.venue and w.axis = p.axis and w.centre = p.centre and w.part = p.part),
inner_ as (select venue, i, j from corr where corridor),
under as (select c.venue, c.i, c.j from inner_ c, lane w where w.venue = c.venue and w.axis = 'y' and abs(c.j + 0.5 - w.centre) <= least(w.w, 12) / 2.0 + 1 and c.i between plo and phi
  union select c.venue, c.i, c.j from inner_ c, lane w where w.venue = c.venue and w.axis = 'x' and abs(c.i + 0.5 - w.centre) <= least(w.w, 12) / 2.0 + 1 and c.j between plo and phi),
rest as (select * from inner_ except select * from under), {_pieces("rest")}
select venue, area, i1 - i0 + 1 as width, j1 - j0 + 1 as height, (i0 + i1 + 1) / 2.0::double as x, (j0 + j1 + 1) / 2.0::double as y from big""")
def uncovered_corridor(spark, sf_dir):
    """The largest pieces of the corridor that lie farther than a metre from the band of any derived way: size, extent and middle."""
    found, _, corridor = lanes.clipped_ways(spark, sf_dir)
    under = corridors.in_bands(corridor.select("venue", "i", "j"), found, (1,)).select("venue", "i", "j")
    rest = corridor.select("venue", "i", "j").join(under, ["venue", "i", "j"], "left_anti").withColumn("free", F.lit(True))
    return largest_pieces(stored(rest, "uncovered")).selectExpr("venue", "area", "i1 - i0 + 1 as width", "j1 - j0 + 1 as height", "(i0 + i1 + 1) / 2D as x", "(j0 + j1 + 1) / 2D as y")


@query(f"""with {DOORS_SQL}, d as (select x + door % 5 as x, y + door % 3 as y, door % 3 = 0 as pub from doors), s as (select a as dx, b as dy from range(-6, 7) x(a), range(-6, 7) y(b)),
p as (select dx, dy, pub, avg(case when pub then sqrt(power(greatest(5.0 - (x + dx), 0, x + dx - 40.0), 2) + power(greatest(20.0 - (y + dy), 0, y + dy - 30.0), 2)) else abs(90.0 - (y + dy)) end) as m from d, s group by all),
c as (select dx, dy, round(avg(m), 9) as cost from p group by all), r as (select *, row_number() over (order by cost, dx, dy) as n from c)
select dx::int as dx, dy::int as dy, cost from r where n = 1""")
def anchor_shift(spark, sf_dir):
    doors = venue.doors(spark, sf_dir).selectExpr("x + door % 5 as x", "y + door % 3 as y", "door % 3 = 0 as is_public")
    return quality.anchor_shift(doors, (5.0, 20.0, 40.0, 30.0), 90.0, 6)


@query(f"""with {STANDS_SQL}, a as (select distinct 'RUA ' || left(code, 1) as name from stands), w as (select distinct upper('Rua ' || left(code, 1)) as name from stands where "row" % 3 = 0)
select name from a except select name from w where name <> 'RUA D'""")
def missing_ways(spark, sf_dir):
    """Streets that an arrow names and no way does."""
    s = venue.stands(spark, sf_dir)
    arrows = s.select(F.concat(F.lit("RUA "), F.substring("code", 1, 1)).alias("name")).distinct()
    found = s.where("row % 3 = 0").select(F.upper(F.concat(F.lit("Rua "), F.substring("code", 1, 1))).alias("name")).where("name <> 'RUA D'")
    return arrows.subtract(found)
