"""Queries on routes, itineraries and instructions."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium import params
from atrium.operators import grid, instructions, itinerary, routing
from atrium.sources import venue
from atrium.sources.venue import STANDS_SQL, VENUES_SQL

from .grids import CELLS_SQL, CLEAR_SQL, HEIGHT, WIDTH, packed
from .registry import query


def requests(spark, sf_dir):
    """One walk an order, in all venues: from the west wall of a row of stands to a place within sixty metres,
    or, of each hundredth customer, anywhere in the venue."""
    n = venue.venues(spark, sf_dir)
    far = f"case when o_custkey % 100 = 0 then cast(o_orderkey * 53 % {HEIGHT} as int) else cast(10 * (o_custkey % 100) + 1 + o_orderkey % 60 as int) end"
    return venue.table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", f"o_custkey % {n}L as venue", "1 as ai", "cast(10 * (o_custkey % 100) + 11 as int) as aj", "cast(o_orderkey * 37 % 140 as int) as bi", f"{far} as bj")


@query()
def route_cost(spark, sf_dir):
    """True least cost of each requested route; null where there is none."""
    found = routing.routes(requests(spark, sf_dir), packed(spark, sf_dir), WIDTH, HEIGHT, paths=False)
    return found.select("id", F.round("cost", 6).alias("cost"))


@query()
def route_path_metres(spark, sf_dir):
    """Metres and corners of the simplified routes: one of several equal paths may be taken."""
    found = routing.routes(requests(spark, sf_dir), packed(spark, sf_dir), WIDTH, HEIGHT)
    return found.select("id", F.round("metres", 3).alias("metres"), F.size("cells").alias("corners"))


@query()
def route_clearance(spark, sf_dir):
    """Figures of each venue's routes: upper median and largest length, corners, clearance along them in metres, and the
    share of samples within a metre of a wall."""
    grids = packed(spark, sf_dir)
    asked = routing.asked_for(requests(spark, sf_dir))
    pair = ["venue", "ai", "aj", "bi", "bj"]
    found = grid.stored(routing.solved(asked, grids, WIDTH, HEIGHT).where("metres is not null").join(asked.hint("merge"), pair), "routes")
    # Each different route stands for the n requests that take it.
    lengths = found.selectExpr("venue", "n", "metres", "size(cells) as corners", "sum(n) over (partition by venue order by metres rows between unbounded preceding and current row) as upto", "sum(n) over (partition by venue) as routes")
    per = lengths.groupBy("venue").agg(F.min(F.expr("case when upto > routes div 2 then metres end")).alias("median_m"), F.max("metres").alias("max_m"), (F.sum(F.col("corners") * F.col("n")) / F.sum("n")).alias("corners"), F.sum("n").alias("routes"))
    along = routing.clearance_along(found.withColumn("id", F.struct(*pair[1:])), grids, WIDTH, HEIGHT, least_m=40.0).join(found.select("venue", F.struct(*pair[1:]).alias("id"), "n").hint("merge"), ["venue", "id"])
    along = along.groupBy("venue").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum(F.col("samples") * F.col("n"))).alias(n) for c, n in (("clearance_m", "clearance_m"), ("near", "hugging"))])
    return per.join(along.withColumn("hugging", 100 * F.col("hugging")), "venue", "left").select("venue", "routes", *[F.round(c, 3).alias(c) for c in ("median_m", "max_m", "corners", "clearance_m", "hugging")])


def destinations_and_doors(spark, sf_dir):
    """Destinations, one a customer, and doors, those of the suppliers on each venue's west wall."""
    n = venue.venues(spark, sf_dir)
    dest = venue.table(spark, sf_dir, "customer").selectExpr(f"c_custkey % {n}L as venue", "c_custkey as dest", "cast(c_custkey * 37 % 140 as int) as bi", f"cast(c_custkey * 53 % {HEIGHT} as int) as bj")
    doors = venue.table(spark, sf_dir, "supplier").selectExpr(f"s_suppkey % {n}L as venue", "s_suppkey as door", "1 as ai", f"cast(100 * (s_suppkey div {n}L % 10) + 11 as int) as aj")
    return dest, doors.groupBy("venue", "ai", "aj").agg(F.min("door").alias("door"))


#: Costs spread from all doors cell by cell: in each round the cells that got cheaper pass their cost on.
_DOOR_SQL = f"""{CELLS_SQL}, {CLEAR_SQL}, {VENUES_SQL}, fac as materialized (select venue, i, j, 1 + {params.WALL_PENALTY} * (1 - least(1.0, d / {params.COMFORT_M})) as f from near),
st as (select * from (values (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)) t(a, b)),
step as materialized (select f.venue, f.i - a as i, f.j - b as j, f.i as ti, f.j as tj, sqrt((a * a + b * b)::double) * f.f as w from fac f, st
  where (a = 0 or b = 0 or exists (select 1 from fac t where t.venue = f.venue and t.i = f.i - a and t.j = f.j) and exists (select 1 from fac t where t.venue = f.venue and t.i = f.i and t.j = f.j - b))),
door as (select s_suppkey % nv as venue, 1 as i, (100 * (s_suppkey // nv % 10) + 11)::int as j, min(s_suppkey) as door from supplier, nv group by all),
best(venue, i, j, cost, door) using key (venue, i, j) as (select venue, i, j, 0.0::double, door from door join fac using (venue, i, j)
  union (select s.venue, s.ti, s.tj, min(b.cost + s.w), arg_min(b.door, (b.cost + s.w, b.door)) from best b join step s on s.venue = b.venue and s.i = b.i and s.j = b.j
    left join recurring.best r on r.venue = s.venue and r.i = s.ti and r.j = s.tj where r.cost is null or b.cost + s.w < r.cost group by s.venue, s.ti, s.tj)),
dest as (select c_custkey as dest, c_custkey % nv as venue, (c_custkey * 37 % 140)::int as i, (c_custkey * 53 % {HEIGHT})::int as j from customer, nv)"""


@query(f"with recursive {_DOOR_SQL} select dest, door, round(cost, 6) as cost from dest join best using (venue, i, j)")
def nearest_door(spark, sf_dir):
    """The cheapest way in to each destination and its door: one search a venue from all its doors."""
    dest, doors = destinations_and_doors(spark, sf_dir)
    found = routing.nearest_by_cost(dest, doors, packed(spark, sf_dir), WIDTH, HEIGHT).where("cost is not null")
    return found.select("dest", "door", F.round("cost", 6).alias("cost"))


@query()
def best_door_by_metres(spark, sf_dir):
    """The door with the shortest simplified route."""
    dest, doors = destinations_and_doors(spark, sf_dir)
    return routing.best_door(dest, doors, packed(spark, sf_dir), WIDTH, HEIGHT).select("dest", "door", F.round("metres", 3).alias("metres"))


_STOPS = """stops as (select l_orderkey as itin, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)::int as pos, (l_partkey * 7 % 140)::double as x, case when l_suppkey % 11 = 0 then null else (l_partkey * 3 % 97)::double end as y0 from lineitem),
s as (select itin, pos, case when y0 is null then null else x end as x, y0 as y from stops)"""


def stops(spark, sf_dir):
    """The lines of an order as the stops of an itinerary; some aren't filled in."""
    rows = venue.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as itin", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos", "cast(l_partkey * 7 % 140 as double) as x0", "case when l_suppkey % 11 = 0 then null else cast(l_partkey * 3 % 97 as double) end as y")
    return rows.selectExpr("itin", "cast(pos as int) as pos", "case when y is not null then x0 end as x", "y")


@query(f"with {_STOPS} select itin, pos, case when pos = min(pos) over w then 'origem' when pos = max(pos) over w then 'destino' else 'parada' end as role, chr((65 + (pos - 1) % 26)::int) as letter from s window w as (partition by itin)")
def stop_roles(spark, sf_dir):
    return itinerary.with_roles(stops(spark, sf_dir)).select("itin", "pos", "role", "letter")


@query(f"""with {_STOPS}, l as (select itin, pos, x, y, lead(x) over w as tx, lead(y) over w as ty, lead(pos) over w as n from s window w as (partition by itin order by pos))
select itin, pos, case when tx is not null then x end as x, case when tx is not null then y end as y, case when x is not null then tx end as tx, case when x is not null then ty end as ty from l where n is not null""")
def leg_pairs(spark, sf_dir):
    return itinerary.leg_pairs(stops(spark, sf_dir))


@query(f"""with {_STOPS}, l as (select itin, pos, sqrt(power(lead(x) over w - x, 2) + power(lead(y) over w - y, 2)) as m, lead(pos) over w as n from s window w as (partition by itin order by pos)),
t as (select itin, count(*) as legs, sum(m) as m, bool_and(m is not null) as whole from l where n is not null group by itin)
select itin, legs, round(case when whole then m end, 6) as metres, case when whole then greatest(1, floor(m / 75 + 0.5))::bigint end as minutes from t""")
def itinerary_total(spark, sf_dir):
    legs = itinerary.leg_pairs(stops(spark, sf_dir)).withColumn("metres", F.hypot(F.col("tx") - F.col("x"), F.col("ty") - F.col("y")))
    return itinerary.totals(legs).select("itin", "legs", F.round("metres", 6).alias("metres"), "minutes")


_SHORT = """whole as (select itin, pos, (l.pos * 0 + x)::double as x, y from (select l_orderkey as itin, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)::int as pos, (l_partkey * 7 % 140)::double as x, (l_partkey * 3 % 97)::double as y from lineitem) l),
few as (select * from whole where itin in (select itin from whole group by itin having count(*) between 4 and 8))"""


def short_itineraries(spark, sf_dir):
    """Orders of 4 lines, from which an order can be better, to as many as an itinerary holds."""
    rows = venue.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as itin", "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as pos", "cast(l_partkey * 7 % 140 as double) as x", "cast(l_partkey * 3 % 97 as double) as y")
    return rows.selectExpr("*", "count(*) over (partition by itin) as n").where(f"n between 4 and {params.MAX_STOPS}").drop("n")


@query(f"""with recursive {_SHORT}, e as (select itin, min(pos) as a, max(pos) as b from few group by itin),
p(itin, route, metres, n) as (select itin, [a], 0.0::double, 1 from e union all
  select p.itin, list_append(p.route, t.pos), p.metres + sqrt(power(t.x - f.x, 2) + power(t.y - f.y, 2)), n + 1 from p join e on e.itin = p.itin join few f on f.itin = p.itin and f.pos = p.route[-1]
  join few t on t.itin = p.itin and not list_contains(p.route, t.pos) and (t.pos <> e.b or len(p.route) = (select count(*) - 1 from few c where c.itin = p.itin)))
select itin, round(min(metres), 6) as metres from p join e using (itin) where route[-1] = b group by itin""")
def best_order_exhaustive(spark, sf_dir):
    return itinerary.best_order(short_itineraries(spark, sf_dir)).select("itin", F.round("metres", 6).alias("metres"))


@query()
def best_order_2opt(spark, sf_dir):
    """2-opt orders of the itineraries and whether the gain is worth a change."""
    found = itinerary.accepted(itinerary.two_opt(short_itineraries(spark, sf_dir)))
    return found.select("itin", F.size("route").alias("stops"), F.round("metres", 3).alias("metres"), "accepted")


@query(f"""with recursive {_SHORT}, e as (select itin, min(pos) as a, max(pos) as b from few group by itin),
p(itin, route, metres, n) as (select itin, [a], 0.0::double, 1 from e union all
  select p.itin, list_append(p.route, t.pos), p.metres + sqrt(power(t.x - f.x, 2) + power(t.y - f.y, 2)), n + 1 from p join e on e.itin = p.itin join few f on f.itin = p.itin and f.pos = p.route[-1]
  join few t on t.itin = p.itin and not list_contains(p.route, t.pos) and (t.pos <> e.b or len(p.route) = (select count(*) - 1 from few c where c.itin = p.itin))),
o as (select itin, min(metres) as metres from p join e using (itin) where route[-1] = b group by itin),
l as (select itin, sqrt(power(lead(x) over w - x, 2) + power(lead(y) over w - y, 2)) as m from few window w as (partition by itin order by pos)), c as (select itin, sum(m) as before from l group by itin)
select itin, round(metres, 6) as metres, round(before, 6) as before, before - metres > 0.5 as accepted from o join c using (itin)""")
def itinerary_optimised(spark, sf_dir):
    """The better order of each itinerary, all orders tried, and whether it is worth a change."""
    found = itinerary.optimise(short_itineraries(spark, sf_dir))
    return found.select("itin", F.round("metres", 6).alias("metres"), F.round("before", 6).alias("before"), "accepted")


@query()
def itinerary_routed(spark, sf_dir):
    """The better order of each itinerary by the metres that are really walked, between places along the streets."""
    n = venue.venues(spark, sf_dir)
    rows = short_itineraries(spark, sf_dir).selectExpr("itin", "pos", "x", "y", f"itin % {n}L as venue", "cast(10 * (pos + itin % 7) + 11 + pos % 3 as int) as j", "cast(14 * floor(x / 14) + 7 as int) as i")
    legs = itinerary.routed_legs(rows, packed(spark, sf_dir), WIDTH, HEIGHT)
    return itinerary.optimise(rows, legs, both_ways=True).select("itin", F.size("route").alias("stops"), F.round("metres", 3).alias("metres"), F.round("before", 3).alias("before"), "accepted")


#: Streets between the rows of stands, and the gaps between their blocks.
_WAYS = f"""{STANDS_SQL}, wr as (select distinct venue, "row" % 100 as r from stands), ways as (select venue, r + 1 as ord, 'Rua ' || chr((65 + r % 26)::int) || (r // 26) as name, false as derived, 0.0::double as ax, (11.5 + 10 * r)::double as ay, 139.0::double as bx, (11.5 + 10 * r)::double as "by", 4.0::double as width from wr
  union all select venue, 101 + c, 'Transversal ' || lpad((c + 1)::varchar, 2, '0'), true, (35.5 + 34 * c)::double, 0.0::double, (35.5 + 34 * c)::double, {HEIGHT - 1}.0::double, 4.0::double from (select distinct venue from stands), range(3) u(c))"""


def ways(spark, sf_dir):
    """A street under each row of stands and three transversals a venue, in cells."""
    s = venue.stands(spark, sf_dir)
    street = s.selectExpr("venue", "row % 100 as r").distinct().selectExpr("venue", "r + 1 as ord", "concat('Rua ', chr(65 + r % 26), r div 26) as name", "false as derived", "array(array(struct(0.0D as x, 11.5D + 10 * r as y), struct(139.0D as x, 11.5D + 10 * r as y))) as lines", "4.0D as width")
    cross = s.select("venue").distinct().selectExpr("venue", "explode(sequence(0, 2)) as c").selectExpr("venue", "cast(101 + c as long) as ord", "concat('Transversal ', lpad(cast(c + 1 as string), 2, '0')) as name", "true as derived", f"array(array(struct(35.5D + 34 * c as x, 0.0D as y), struct(35.5D + 34 * c as x, {HEIGHT - 1}.0D as y))) as lines", "cast(null as double) as width")
    return instructions.ways_in_cells(street.unionByName(cross), lambda x, y: (F.col(x), F.col(y)), keep=("venue",))


@query(f"""with {_WAYS} select venue, ord, name, derived, ax, ay, bx, "by", width from ways""")
def ways_in_cells(spark, sf_dir):
    return ways(spark, sf_dir).select("venue", "ord", "name", "derived", "ax", "ay", "bx", "by", "width")


_LEGS = f"""{VENUES_SQL}, legs as (select o_orderkey as leg, o_custkey % nv as venue, (o_custkey * 7 % 140)::double as pi, (10 * (o_custkey % 4) + 11 + o_custkey % 3)::double as pj, (case when o_orderkey % 2 = 0 then o_orderkey * 5 % 140 else o_custkey * 7 % 140 + 1 end)::double as qi, (case when o_orderkey % 2 = 0 then 10 * (o_custkey % 4) + 12 else o_orderkey % 44 end)::double as qj from orders, nv)"""


def legs(spark, sf_dir):
    rows = venue.table(spark, sf_dir, "orders")
    return rows.selectExpr("o_orderkey as leg", f"o_custkey % {venue.venues(spark, sf_dir)}L as venue", "cast(o_custkey * 7 % 140 as double) as pi", "cast(10 * (o_custkey % 4) + 11 + o_custkey % 3 as double) as pj", "cast(case when o_orderkey % 2 = 0 then o_orderkey * 5 % 140 else o_custkey * 7 % 140 + 1 end as double) as qi", "cast(case when o_orderkey % 2 = 0 then 10 * (o_custkey % 4) + 12 else o_orderkey % 44 end as double) as qj")


@query(f"""with {_WAYS}, {_LEGS}, t as (select leg, ord, name, width, pi + (qi - pi) * (s / 16.0::double) as x, pj + (qj - pj) * (s / 16.0::double) as y, ax, ay, bx, "by" from legs join ways on ways.venue = legs.venue, range(17) z(s)),
d as (select leg, ord, name, width, x, y, ax, ay, bx, "by", greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * ("by" - ay)) / ((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)))) as u from t),
c as (select leg, ord, name, width, round(avg(case when sqrt(power(x - (ax + u * (bx - ax)), 2) + power(y - (ay + u * ("by" - ay)), 2)) <= width / 2 + 3 then 1.0 else 0.0 end), 9) as cov from d group by all),
b as (select *, row_number() over (partition by leg order by cov desc, width desc, ord) as n from c where cov >= 0.7)
select legs.leg, b.name as way, b.cov as coverage from legs left join b on b.leg = legs.leg and n = 1""")
def leg_way_coverage(spark, sf_dir):
    return instructions.leg_ways(legs(spark, sf_dir), ways(spark, sf_dir)).select("leg", "way", "coverage")


_TURNS = """d as (select l_orderkey as route, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as seq, (l_partkey % 9 - 4)::double as dx, (l_suppkey % 7 - 3)::double as dy, case when l_partkey % 3 = 0 then null else 'Rua ' || (l_partkey % 2) end as way from lineitem),
p as (select *, lag(dx) over w as px, lag(dy) over w as py, lag(way) over w as bw from d window w as (partition by route order by seq)),
a as (select *, degrees(acos(greatest(-1, least(1, (px * dx + py * dy) / case when sqrt(px * px + py * py) * sqrt(dx * dx + dy * dy) = 0 then 1 else sqrt(px * px + py * py) * sqrt(dx * dx + dy * dy) end)))) as angle from p),
t as (select *, case when px is null then 'partida' when round(angle, 6) >= 30 then case when -(px * dy - py * dx) > 0 then 'esquerda' else 'direita' end else 'frente' end as turn from a)"""


@query(f"with {_TURNS} select route, seq, turn, turn = 'frente' and way is not null and way is distinct from bw as changed from t")
def turn_classification(spark, sf_dir):
    rows = venue.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as route", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as seq", "cast(l_partkey % 9 - 4 as double) as dx", "cast(l_suppkey % 7 - 3 as double) as dy", "case when l_partkey % 3 = 0 then null else concat('Rua ', l_partkey % 2) end as way")
    return instructions.turns(rows, handedness=-1).select("route", "seq", "turn", "changed")


@query()
def instruction_steps(spark, sf_dir):
    """Spoken steps of the requested routes."""
    rows, pair = requests(spark, sf_dir), ["venue", "ai", "aj", "bi", "bj"]
    # Each different route is told once; route numbers it, over all venues.
    n = f"(((venue * {HEIGHT} + aj) * {WIDTH} + ai) * {HEIGHT} + bj) * {WIDTH} + bi"
    found = grid.stored(routing.solved(routing.asked_for(rows), packed(spark, sf_dir), WIDTH, HEIGHT).where("size(cells) > 1"), "routes")
    parts = found.selectExpr("venue", f"{n} as route", "posexplode(zip_with(slice(cells, 1, size(cells) - 1), slice(cells, 2, size(cells) - 1), (p, q) -> struct(p, q))) as (seq, c)")
    legs = parts.selectExpr("venue", "route", "seq", "struct(route, seq) as leg", "cast(c.p.i as double) as pi", "cast(c.p.j as double) as pj", "cast(c.q.i as double) as qi", "cast(c.q.j as double) as qj")
    named = instructions.leg_ways(legs, ways(spark, sf_dir)).selectExpr("route", "seq", "qi - pi as dx", "qj - pj as dy", "hypot(qi - pi, qj - pj) as metres", "way", "derived", "cast(null as string) as label")
    steps = grid.stored(instructions.instructions(named, handedness=-1).withColumn("metres", F.round("metres", 3)), "steps")
    told = rows.selectExpr("id", f"{n} as route").join(steps.hint("merge"), "route").withColumn("label", F.concat(F.lit("Estande "), F.col("id")))
    text = F.when(F.col("turn") == "chegada", instructions.arrival(F.col("label"))).otherwise(F.col("text"))
    return told.select(F.col("id").alias("route"), "seq", "turn", "way", "derived", "metres", text.alias("text"))


@query("""with l as (select l_orderkey as route, l_linenumber, sqrt(power(l_partkey % 40, 2) + power(l_suppkey % 30, 2)) as m, (l_partkey % 7)::double as clear from lineitem),
r as (select route, sum(m) as m, count(*) - 1 as turns, avg(clear) as clear, avg(case when clear < 1 then 100.0 else 0.0 end) as hug from l group by route)
select round(list_sort(list(m))[count(*) // 2 + 1], 6) as median_m, round(max(m), 6) as max_m, round(avg(turns), 6) as mean_turns, round(avg(clear), 6) as mean_clear, round(avg(hug), 6) as hugging from r""")
def route_statistics(spark, sf_dir):
    """Upper median and extremes of route lengths, turns, clearance and wall hugging."""
    from atrium.operators.quality import upper_median

    rows = venue.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as route", "sqrt(power(l_partkey % 40, 2) + power(l_suppkey % 30, 2)) as m", "cast(l_partkey % 7 as double) as clear")
    per = rows.groupBy("route").agg(F.sum("m").alias("m"), (F.count("*") - 1).alias("turns"), F.avg("clear").alias("clear"), F.avg(F.when(F.col("clear") < 1, 100.0).otherwise(0.0)).alias("hug"))
    out = per.agg(F.max("m").alias("x"), F.avg("turns").alias("t"), F.avg("clear").alias("c"), F.avg("hug").alias("h"))
    median = upper_median(per, "m")
    return out.crossJoin(median).select(F.round("median", 6).alias("median_m"), F.round("x", 6).alias("max_m"), F.round("t", 6).alias("mean_turns"), F.round("c", 6).alias("mean_clear"), F.round("h", 6).alias("hugging"))
