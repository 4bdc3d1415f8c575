"""Queries on corridors and ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium import params
from atrium.operators import corridors, grid
from atrium.sources import venue

from .grids import CELLS_SQL, blocks, cells
from .registry import query

#: Closing radius of the fixture: four metres bridge its aisles.
CLOSE = 3
_CORRIDOR = f"""{CELLS_SQL}, tk as (select venue, i, j, not free as taken from cells),
d1 as (select *, max(taken) over (partition by venue, j order by i rows between {CLOSE} preceding and {CLOSE} following) as h from tk),
d2 as (select *, max(h) over (partition by venue, i order by j rows between {CLOSE} preceding and {CLOSE} following) as h2 from d1),
e1 as (select *, min(h2) over (partition by venue, j order by i rows between {CLOSE} preceding and {CLOSE} following) as h3 from d2),
e2 as (select *, min(h3) over (partition by venue, i order by j rows between {CLOSE} preceding and {CLOSE} following) as hull from e1),
c as (select venue, i, j, taken, hull, hull and not taken as c from e2),
o1 as (select *, min(c) over (partition by venue, j order by i rows between 1 preceding and 1 following) as p from c),
o2 as (select *, min(p) over (partition by venue, i order by j rows between 1 preceding and 1 following) as q from o1),
o3 as (select *, max(q) over (partition by venue, j order by i rows between 1 preceding and 1 following) as r from o2),
o4 as (select *, max(r) over (partition by venue, i order by j rows between 1 preceding and 1 following) as s from o3),
corr as (select venue, i, j, s and hull and not taken as corridor from o4)"""
_RUNS = """g as (select venue, 'y' as axis, i as a, j as b, j - row_number() over (partition by venue, i order by j) as isle from corr where corridor union all select venue, 'x', j, i, i - row_number() over (partition by venue, j order by i) from corr where corridor),
runs as (select venue, axis, a, min(b) as lo, max(b) as hi, max(b) - min(b) + 1 as width, (min(b) + max(b) + 1) / 2.0::double as centre from g group by venue, axis, a, isle)"""


def corridor_cells(spark, sf_dir):
    return corridors.walkable(cells(spark, sf_dir).selectExpr("venue", "i", "j", "not free as taken"), CLOSE, 1)


def runs(spark, sf_dir, stored_cells=None):
    """Runs on the scan lines of both axes; the corridor's cells are written once for both."""
    c = stored_cells if stored_cells is not None else grid.stored(corridor_cells(spark, sf_dir).where("corridor").select("venue", "i", "j", "corridor"), "corridor")
    one = lambda axis, along, across: corridors.scan_runs(c, along, across).withColumn("axis", F.lit(axis))
    return one("y", "i", "j").union(one("x", "j", "i"))


@query(f"with {_CORRIDOR} select venue, i, j from corr where corridor")
def circulation_cells(spark, sf_dir):
    """Closing, difference and opening on the raster."""
    return corridor_cells(spark, sf_dir).where("corridor").select("venue", "i", "j")


def _slid(steps: list[tuple[str, str, int]], source: str, column: str) -> str:
    """CTEs in DuckDB that slide ``column`` of ``source`` along both axes, step by step: (name, function, radius)."""
    out = []
    for name, f, r in steps:
        for axis, (key, order) in (("h", ("j", "i")), ("", ("i", "j"))):
            out.append(f"{name}{axis} as (select * exclude ({column}), {f}({column}) over (partition by venue, {key} order by {order} rows between {r} preceding and {r} following) as {column} from {source})")
            source = f"{name}{axis}"
    return ", ".join(out)


_APRON = f"""{CELLS_SQL}, w0 as (select venue, i, j, not free as taken, not free as hull from cells), {_slid([("wc", "max", params.CLOSING_M), ("we", "min", params.CLOSING_M)], "w0", "hull")},
a0 as (select *, taken as apron from we), {_slid([("wa", "max", params.APRON_M)], "a0", "apron")},
b0 as (select venue, min(i) as i0, max(i) as i1, min(j) as j0, max(j) as j1 from w0 where taken group by venue),
p0 as (select wa.venue, wa.i, wa.j, wa.taken, (wa.hull or wa.apron and wa.i between i0 and i1 and wa.j between j0 and j1) and not wa.taken as walk from wa join b0 on b0.venue = wa.venue),
{_slid([("wo", "min", 1), ("wp", "max", 1)], "p0", "walk")}"""


@query(f"with {_APRON} select venue, i, j from wp where walk and not taken")
def walkable_cells(spark, sf_dir):
    """The corridors' hull and the apron around the blocks, without the blocks, opened."""
    taken = cells(spark, sf_dir).selectExpr("venue", "i", "j", "not free as taken")
    return corridors.walkable_with_apron(taken).where("walkable").select("venue", "i", "j")


@query(f"with {_CORRIDOR}, {_RUNS} select venue, axis, a, lo, hi, width::int as width, centre::double as centre from runs")
def corridor_runs(spark, sf_dir):
    return runs(spark, sf_dir).select("venue", "axis", "a", "lo", "hi", "width", "centre")


#: In this fixture tracks are separable by their centre: islands of samples at most 14 apart.
_TRACKS = f"""s as (select venue, axis, a, centre, width from runs where width between {params.WIDTH_MIN} and 5),
t as (select *, case when a - lag(a) over (partition by venue, axis, centre order by a) <= 14 then 0 else 1 end as opens from s),
u as (select *, sum(opens) over (partition by venue, axis, centre order by a) as part from t),
tway as (select venue, axis, centre, part, list_sort(list(width))[count(*) // 2 + 1] as w, min(a) as lo, max(a) as hi, count(*) as extent from u group by venue, axis, centre, part having count(*) >= 12),
pieces as (select t.venue, t.axis, t.centre, t.part, t.w, t.lo, t.hi, greatest(r.lo, t.lo) as plo, least(r.hi, t.hi) as phi from tway t join runs r on r.venue = t.venue and r.axis <> t.axis and r.a = floor(t.centre)::int and r.hi >= t.lo and r.lo <= t.hi
  where least(r.hi, t.hi) - greatest(r.lo, t.lo) + 1 >= least(t.w, 12)),
ways as (select venue, axis, centre, part, w, lo, hi, sum(phi - plo + 1)::bigint as extent, count(*) as n_lines from pieces group by all having sum(phi - plo + 1) >= 12)"""


def tracked(all_runs):
    return corridors.tracks(all_runs.where(f"width between {params.WIDTH_MIN} and 5").select("venue", "axis", "a", "centre", "width"), tol=0.25)


def clipped_ways(spark, sf_dir):
    """(ways cut to the corridor, runs, corridor cells), each written once."""
    c = grid.stored(corridor_cells(spark, sf_dir).where("corridor").select("venue", "i", "j", "corridor"), "corridor")
    all_runs = grid.stored(runs(spark, sf_dir, c), "corridor-runs")
    return corridors.clip_ways(corridors.ways(tracked(all_runs)), all_runs), all_runs, c


@query(f"""with {_CORRIDOR}, {_RUNS}, {_TRACKS} select venue, axis, centre::double as centre, w::int as width, lo as "from", hi as "to", extent from tway""")
def corridor_tracks(spark, sf_dir):
    return corridors.ways(tracked(runs(spark, sf_dir))).select("venue", "axis", "centre", "width", "from", "to", "extent")


_ARROWS = f"""arrows as (select venue, "row" as ord, 'RUA ' || chr((65 + "row" % 11)::int) as name, 'y' as axis, 70 as along, (10 * ("row" % 100) + 12)::double as across from (select distinct venue, "row" from blocks))"""
_NAMED = f"""{_ARROWS},
votes as (select w.venue, w.axis, centre, part, name, count(*) as n, min(ord) as f from ways w join arrows a on a.venue = w.venue and a.axis = w.axis and along between lo and hi and abs(across - centre) <= least(w, 12) / 2.0 + 1 group by all),
b as (select *, row_number() over (partition by venue, axis, centre, part order by n desc, f, name) as r from votes),
m as (select w.*, b.name as arrow from ways w left join b on b.venue = w.venue and b.axis = w.axis and b.centre = w.centre and b.part = w.part and r = 1 where b.name is not null or extent >= 20),
n as (select *, coalesce(arrow, case when axis = 'x' then 'Transversal ' else 'Alameda ' end || lpad((row_number() over (partition by venue, axis, arrow is null order by centre, lo))::varchar, 2, '0')) as name from m),
merged as (select venue, name, axis, round(avg(least(w, 12)), 1)::double as width, sum(extent)::bigint as extent, bool_or(w > 12) as open, bool_or(arrow is null) as derived, count(*) as parts, sum(n_lines) as n_lines from n group by venue, name, axis)"""


def named_ways(spark, sf_dir):
    found, all_runs, c = clipped_ways(spark, sf_dir)
    arrows = blocks(spark, sf_dir).select("venue", "row").distinct().selectExpr("venue", "row as ord", "concat('RUA ', chr(65 + row % 11)) as name", "'y' as axis", "70 as along", "cast(10 * (row % 100) + 12 as double) as across")
    return corridors.name_ways(found, arrows), all_runs, c


@query(f"""with {_CORRIDOR}, {_RUNS}, {_TRACKS}, {_NAMED} select venue, name, axis, width, extent, open, derived, parts from merged""")
def way_naming(spark, sf_dir):
    """Ways named by their arrows or numbered, then merged by name."""
    return corridors.merge_ways(named_ways(spark, sf_dir)[0]).select("venue", "name", "axis", "width", "extent", "open", "derived", "parts")


@query(f"""with {_CORRIDOR}, {_RUNS}, {_TRACKS}, {_NAMED}, l as (select *, row_number() over (partition by venue, axis order by extent desc, name) as r from merged where n_lines = 1)
select venue, axis, name, extent from l where r = 1""")
def longest_way(spark, sf_dir):
    """The longest way of each axis that is one line."""
    return corridors.longest_ways(corridors.merge_ways(named_ways(spark, sf_dir)[0]))


@query(f"""with {_CORRIDOR}, {_RUNS}, sa as (select venue, "row" as ord, 'RUA V' || ("row" % 5) as name, 10 * ("row" % 100) + 7 + case when "row" % 3 = 0 then 0.4 else 0 end as along, 36.0::double as across from (select distinct venue, "row" from blocks)),
off as (select unnest([{', '.join(map(str, params.SEED_OFFSETS))}]) as d),
wd as (select a.venue, a.ord, list_sort(list(r.width))[count(*) // 2 + 1] as w from sa a, off, runs r where r.venue = a.venue and r.axis = 'x' and r.a = floor(a.along + d)::int and across >= r.lo and across < r.hi + 1 and r.width between 2 and 20 group by 1, 2),
un as (select a.*, r.lo, r.hi from sa a join runs r on r.venue = a.venue and r.axis = 'y' and r.a = floor(a.across)::int and a.along > r.lo - 0.6 and a.along < r.hi + 1.6 qualify row_number() over (partition by a.venue, a.ord order by r.lo) = 1 and r.hi - r.lo + 1 >= 12),
gr as (select un.*, wd.w from un join wd on wd.venue = un.venue and wd.ord = un.ord), fi as (select venue, name, min(ord) as ord from gr group by 1, 2)
select gr.venue, gr.name, 'x' as axis, across as centre, least(w, 12)::int as width, w > 12 as open, (hi - lo + 1)::bigint as extent, lo as "from", hi as "to" from gr join fi on fi.venue = gr.venue and fi.name = gr.name and fi.ord = gr.ord""")
def seeded_ways(spark, sf_dir):
    """Ways that only their arrow tells of: measured beside it, along the corridor under it."""
    named, all_runs, _ = named_ways(spark, sf_dir)
    arrows = blocks(spark, sf_dir).select("venue", "row").distinct().selectExpr("venue", "row as ord", "concat('RUA V', row % 5) as name", "'x' as axis", "10 * (row % 100) + 7 + case when row % 3 = 0 then 0.4D else 0D end as along", "36.0D as across")
    out = corridors.seed_ways(arrows, named, all_runs)
    return out.select("venue", "name", "axis", "centre", F.col("width").cast("int").alias("width"), "open", "extent", F.col("lines")[0]["from"].alias("from"), F.col("lines")[0]["to"].alias("to"))


@query(f"""with {_CORRIDOR}, {_RUNS}, {_TRACKS}, mg as (select unnest([0, 1, 2, 4]) as margin), li as (select p.venue, p.axis, p.centre, p.w, p.plo, p.phi from pieces p join ways w on w.venue = p.venue and w.axis = p.axis and w.centre = p.centre and w.part = p.part),
ce as (select venue, i, j from corr where corridor),
co as (select distinct c.venue, c.i, c.j, margin from ce c, mg, li w where w.venue = c.venue and w.axis = 'y' and abs(c.j + 0.5 - w.centre) <= least(w.w, 12) / 2.0 + margin and c.i between plo and phi
  union select distinct c.venue, c.i, c.j, margin from ce c, mg, li w where w.venue = c.venue and w.axis = 'x' and abs(c.i + 0.5 - w.centre) <= least(w.w, 12) / 2.0 + margin and c.j between plo and phi)
select margin::double as margin, round(count(*) / (select count(*) from ce), 6)::double as share from co group by margin""")
def way_coverage(spark, sf_dir):
    """Share of the corridor that lies under the derived ways' bands, at four margins."""
    found, _, c = clipped_ways(spark, sf_dir)
    total = c.agg(F.count("*").alias("total"))
    per = corridors.in_bands(c.select("venue", "i", "j"), found, (0, 1, 2, 4)).groupBy("margin").agg(F.count("*").alias("n"))
    return per.crossJoin(total).select("margin", F.round(F.col("n") / F.col("total"), 6).alias("share"))
