"""Queries on the routing grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium.operators import grid
from atrium.sources import venue
from atrium.sources.venue import STANDS_SQL, VENUES_SQL, VISITORS_SQL

from .registry import query

#: Cells of one metre over a whole venue.
WIDTH, HEIGHT = venue.WIDTH, 10 * venue.VENUE_ROWS + 8
CELLS_SQL = f"""{STANDS_SQL}, blocks as (select * from stands where k % 13 <> 0),
v as (select distinct venue from stands), ij as (select venue, i::int as i, j::int as j from v, range({WIDTH}) a(i), range({HEIGHT}) b(j)),
taken as (select venue, i, unnest(range(y0::int, y1::int)) as j from (select venue, unnest(range(x0::int, x1::int)) as i, y0, y1 from blocks)),
cells as (select ij.venue, ij.i, ij.j, ij.i + 0.5 as cx, ij.j + 0.5 as cy, t.i is null as free from ij left join taken t on t.venue = ij.venue and t.i = ij.i and t.j = ij.j)"""
EDGES_SQL = """f as (select venue, i, j from cells where free), s as (select * from (values (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)) t(a, b)),
edges as (select f.venue, f.i, f.j, f.i + a as ti, f.j + b as tj, case when a = 0 or b = 0 then 1.0 else sqrt(2.0) end::double as length from f, s
  where exists (select 1 from f t where t.venue = f.venue and t.i = f.i + a and t.j = f.j + b)
  and (a = 0 or b = 0 or exists (select 1 from f t where t.venue = f.venue and t.i = f.i + a and t.j = f.j) and exists (select 1 from f t where t.venue = f.venue and t.i = f.i and t.j = f.j + b)))"""


def blocks(spark, sf_dir):
    return venue.stands(spark, sf_dir).where("k % 13 <> 0")


def lines(spark, sf_dir):
    """(venue, j): the lines of all venues' grids."""
    every = venue.stands(spark, sf_dir).select("venue").distinct()
    return every.select("venue", F.explode(F.expr(f"sequence(0, {HEIGHT - 1})")).alias("j"))


def cells(spark, sf_dir):
    return grid.rasterise(lines(spark, sf_dir), blocks(spark, sf_dir), WIDTH)


def cells_to_join(spark, sf_dir):
    """cells, in the form that SQL may join as it likes."""
    return grid.rasterise_to_join(lines(spark, sf_dir), blocks(spark, sf_dir), WIDTH)


def packed(spark, sf_dir):
    """(venue, bits): each venue's grid as one value, made from its lines."""
    return grid.stored(grid.packed_lines(grid.taken_on_lines(lines(spark, sf_dir), blocks(spark, sf_dir), WIDTH), WIDTH, HEIGHT), "grids")


@query(f"with {CELLS_SQL} select venue, i, j, free from cells")
def raster_free_cells(spark, sf_dir):
    return cells(spark, sf_dir).select("venue", "i", "j", "free")


@query(f"""with {CELLS_SQL}, n as (select venue, (j * {WIDTH} + i) // 8 as octet, sum(case when free then 1 << (7 - (j * {WIDTH} + i) % 8) else 0 end)::int as v from cells group by 1, 2)
select venue, to_base64(unhex(string_agg(lpad(hex(v), 2, '0'), '' order by octet))) as bits from n group by venue""")
def grid_bitpack(spark, sf_dir):
    return grid.pack_bits(cells(spark, sf_dir), WIDTH)


@query(f"with {CELLS_SQL} select venue, i, j, free from cells")
def grid_bitunpack(spark, sf_dir):
    return grid.unpack_bits(grid.pack_bits(cells(spark, sf_dir), WIDTH), WIDTH, HEIGHT)


@query(f"with {CELLS_SQL}, {EDGES_SQL} select venue, ti - i as di, tj - j as dj, count(*) as n, round(sum(length), 6) as total from edges group by all")
def edge_list(spark, sf_dir):
    e = grid.edges(cells(spark, sf_dir))
    return e.groupBy("venue", (F.col("ti") - F.col("i")).alias("di"), (F.col("tj") - F.col("j")).alias("dj")).agg(F.count("*").alias("n"), F.round(F.sum("length"), 6).alias("total"))


#: The nearest wall of each row on either side by running maxima and minima, then the rows that can hold a nearer one.
CLEAR_SQL = f"""side as materialized (select venue, i, j, free, least(i - coalesce(max(case when not free then i end) over (partition by venue, j order by i), -1), coalesce(min(case when not free then i end) over (partition by venue, j order by i desc), {WIDTH}) - i) as dx from cells),
rim as materialized (select venue, i, j, dx from side union all select distinct venue, i, unnest([-1, {HEIGHT}]), 0 from side),
reach as (select venue, i, j, dx, unnest(range(-dx, dx + 1)) as dy from side where free),
near as (select r.venue, r.i, r.j, min(greatest(w.dx, abs(dy)) + (sqrt(2.0) - 1) * least(w.dx, abs(dy))) as d from reach r join rim w on w.venue = r.venue and w.i = r.i and w.j = r.j + r.dy group by all),
clear as (select s.venue, s.i, s.j, round(coalesce(d, 0), 6)::double as clearance from side s left join near n on n.venue = s.venue and n.i = s.i and n.j = s.j)"""


@query(f"with {CELLS_SQL}, {CLEAR_SQL} select venue, i, j, clearance from clear")
def clearance_field(spark, sf_dir):
    return grid.clearance(cells(spark, sf_dir).drop("cx", "cy")).select("venue", "i", "j", F.round("clearance", 6).alias("clearance"))


@query(f"""with {CELLS_SQL}, {CLEAR_SQL}, {VISITORS_SQL}, p as (select visitor, venue, floor(x - 0.75 + (visitor % 3) * 0.5 + 0.5)::int as i, floor(y - 0.75 - (visitor % 2) + 0.5)::int as j from visitors)
select p.visitor, round(coalesce(c.clearance, 0), 6)::double as clearance_m from p left join clear c on c.venue = p.venue and c.i = p.i and c.j = p.j""")
def clearance_at(spark, sf_dir):
    """Clearance at places between cells: halves round up, and what lies outside has none."""
    at = venue.visitors(spark, sf_dir).selectExpr("venue", "visitor as id", "x - 0.75 + (visitor % 3) * 0.5D as fi", "y - 0.75 - (visitor % 2) as fj")
    return grid.clearance_at(at, grid.clearance(cells(spark, sf_dir).drop("cx", "cy"))).select(F.col("id").alias("visitor"), F.round("clearance_m", 6).alias("clearance_m"))


@query(f"""with {CELLS_SQL}, {VISITORS_SQL}, p as (select visitor, venue, x - 0.5 as fi, y - 0.5 as fj, floor(x)::int as ci, floor(y)::int as cj from visitors),
n as (select visitor, i, j, greatest(abs(i - ci), abs(j - cj)) as ring, (i - fi) * (i - fi) + (j - fj) * (j - fj) as d2 from p join cells c on c.venue = p.venue and c.free and c.i between ci - 8 and ci + 8 and c.j between cj - 8 and cj + 8),
b as (select *, row_number() over (partition by visitor order by ring, d2, j, i) as r from n)
select p.visitor, b.i, b.j, b.ring from p left join b on b.visitor = p.visitor and r = 1""")
def snap_to_free(spark, sf_dir):
    """Where a tap on the map starts walking."""
    taps = venue.visitors(spark, sf_dir).selectExpr("venue", "visitor as id", "x - 0.5 as fi", "y - 0.5 as fj")
    return grid.snap_to_free(taps, cells(spark, sf_dir), 8).select(F.col("id").alias("visitor"), "i", "j", "ring")


@query(f"""with {CELLS_SQL}, n as (select b.venue, b.k, i, j, sqrt(power(greatest(b.x0 - cx, 0, cx - b.x1), 2) + power(greatest(b.y0 - cy, 0, cy - b.y1), 2)) as d
  from blocks b join cells c on c.venue = b.venue and c.free and cx between b.x0 - 4 and b.x1 + 4 and cy between b.y0 - 4 and b.y1 + 4),
r as (select *, row_number() over (partition by venue, k order by d, j, i) as n from n where d < 4)
select b.venue, b.k, r.i as ai, r.j as aj, round(r.d, 6) as access_m from blocks b left join r on r.venue = b.venue and r.k = b.k and r.n = 1""")
def access_cells(spark, sf_dir):
    rows = grid.access_cells(blocks(spark, sf_dir), cells(spark, sf_dir))
    return rows.select("venue", "k", "ai", "aj", F.round("access_m", 6).alias("access_m"))


#: A wall from north to south that shuts off what lies east of it, but for the odd venues' gates.
def walled(spark, sf_dir):
    return cells(spark, sf_dir).withColumn("free", F.expr("free and not (i = 93 and (venue % 2 = 0 or j <> 20)) and not (i between 30 and 32 and j between 3 and 5 and not (i = 31 and j = 4))"))


#: Runs of free cells are the nodes: with the corner rule two of neighbouring rows touch exactly if they share a column.
_REACH = f"""with recursive {CELLS_SQL}, open_ as (select venue, i, j from cells where free and not (i = 93 and (venue % 2 = 0 or j <> 20)) and not (i between 30 and 32 and j between 3 and 5 and not (i = 31 and j = 4))),
wl as (select *, i - row_number() over (partition by venue, j order by i) as g from open_), rn as (select venue, j, g, min(i) as lo, max(i) as hi from wl group by venue, j, g),
up as (select a.venue, a.j as aj, a.g as ag, b.j as bj, b.g as bg from rn a join rn b on b.venue = a.venue and b.j = a.j + 1 where a.lo <= b.hi and b.lo <= a.hi),
tc as (select * from up union all select venue, bj, bg, aj, ag from up),
rc(venue, j, g) as (select venue, j, g from rn where lo <= 2 and hi >= 2 and j % 10 = 2 union select t.venue, t.bj, t.bg from rc join tc t on t.venue = rc.venue and t.aj = rc.j and t.ag = rc.g),
reach as (select wl.venue, wl.i, wl.j from wl join rc on rc.venue = wl.venue and rc.j = wl.j and rc.g = wl.g)"""


@query(f"{_REACH} select venue, i, j from reach")
def reachable_from_doors(spark, sf_dir):
    w = grid.stored(walled(spark, sf_dir), "walled")
    return grid.reachable(w, w.where("i = 2 and j % 10 = 2 and free"))


@query(f"""{_REACH}, near as (select b.venue, b.k, o.i, o.j, sqrt(power(greatest(b.x0 - o.i - 0.5, 0, o.i + 0.5 - b.x1), 2) + power(greatest(b.y0 - o.j - 0.5, 0, o.j + 0.5 - b.y1), 2)) as d
  from blocks b join open_ o on o.venue = b.venue and o.i + 0.5 between b.x0 - 4 and b.x1 + 4 and o.j + 0.5 between b.y0 - 4 and b.y1 + 4),
acc as (select *, row_number() over (partition by venue, k order by d, j, i) as n from near where d < 4)
select b.venue, b.k, case when a.i is null then 'no access' else 'unreached' end as why from blocks b left join acc a on a.venue = b.venue and a.k = b.k and a.n = 1 left join reach r on r.venue = b.venue and r.i = a.i and r.j = a.j where r.i is null""")
def isolated_blocks(spark, sf_dir):
    """Blocks without an access cell, or whose access cell no door reaches."""
    w = grid.stored(walled(spark, sf_dir), "walled")
    at = grid.access_cells(blocks(spark, sf_dir), w)
    seen = grid.reachable(w, w.where("i = 2 and j % 10 = 2 and free")).selectExpr("venue", "i as ai", "j as aj")
    lost = at.where("ai is not null").join(seen.hint("merge"), ["venue", "ai", "aj"], "left_anti").select("venue", "k", F.lit("unreached").alias("why"))
    return at.where("ai is null").select("venue", "k", F.lit("no access").alias("why")).union(lost)


@query(f"""{_REACH} select o.venue, count(*) filter (where o.i = 2 and o.j % 10 = 2) as doors, count(*) as free, count(*) filter (where r.i is null) as isolated
from open_ o left join reach r on r.venue = o.venue and r.i = o.i and r.j = o.j group by o.venue""")
def grid_report(spark, sf_dir):
    """Door cells, free cells and those that no door reaches."""
    w = grid.stored(walled(spark, sf_dir), "walled")
    free = w.where("free").select("venue", "i", "j", F.expr("i = 2 and j % 10 = 2").alias("door"))
    seen = grid.reachable(w, free.where("door")).withColumn("seen", F.lit(True))
    rows = free.join(seen.hint("merge"), ["venue", "i", "j"], "left")
    return rows.groupBy("venue").agg(F.count_if("door").alias("doors"), F.count("*").alias("free"), F.count_if(F.col("seen").isNull()).alias("isolated"))


@query(f"""with {CELLS_SQL}, a as (select venue, i, j from cells where free), b as (select venue, i, j from cells where i % 3 = 0 or j % 4 = 0)
select 'union' as op, count(*) as n from (select * from a union select * from b) union all select 'intersect', count(*) from (select * from a intersect select * from b) union all select 'difference', count(*) from (select * from a except select * from b)""")
def cell_set_ops(spark, sf_dir):
    """Union, intersection and difference of areas, as sets of cells."""
    c = cells(spark, sf_dir)
    a, b = c.where("free").select("venue", "i", "j"), c.where("i % 3 = 0 or j % 4 = 0").select("venue", "i", "j")
    return grid.set_sizes(a, b)


@query(f"""with {CELLS_SQL}, {VENUES_SQL}, p as (select o_orderkey as id, o_custkey % nv as venue, (o_custkey * 7 % {WIDTH})::int as ai, (o_custkey * 3 % {HEIGHT})::int as aj, (o_orderkey * 5 % {WIDTH})::int as bi, (o_custkey * 3 % {HEIGHT} + o_orderkey % 5)::int as bj from orders, nv),
n as (select *, greatest(abs(bi - ai), abs(bj - aj)) as n from p),
s as (select id, venue, unnest(range(0, n + 1)) as k, n, ai, aj, bi, bj from n),
q as (select id, venue, floor(ai + (bi - ai) * (k::double / greatest(n, 1)) + 0.5)::int as i, floor(aj + (bj - aj) * (k::double / greatest(n, 1)) + 0.5)::int as j from s)
select id, bool_and(coalesce(c.free, false)) as visible, count(*) as samples from q left join cells c on c.venue = q.venue and c.i = q.i and c.j = q.j group by id""")
def line_of_sight(spark, sf_dir):
    """Whether a straight walk between two cells stays on free ones."""
    from atrium.operators.routing import visible

    rows = venue.table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", f"o_custkey % {venue.venues(spark, sf_dir)}L as venue", f"cast(o_custkey * 7 % {WIDTH} as int) as ai", f"cast(o_custkey * 3 % {HEIGHT} as int) as aj", f"cast(o_orderkey * 5 % {WIDTH} as int) as bi", f"cast(o_custkey * 3 % {HEIGHT} + o_orderkey % 5 as int) as bj")
    return visible(rows, cells(spark, sf_dir), WIDTH, HEIGHT).select("id", "visible", "samples")
