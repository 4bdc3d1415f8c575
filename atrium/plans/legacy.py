"""Queries on the older, declarative map."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium import params
from atrium.functions import geometry as geo
from atrium.operators import legacy
from atrium.sources import venue
from atrium.sources.venue import STANDS_SQL

from .registry import query

_KNOTS = [(4.0, 0.0), (34.0, 40.0), (72.0, 90.0), (140.0, 150.0)]
_LINES = [0.0, 6.0, 8.0, 20.0, 50.0, 90.0, 120.0]


@query(f"""with {STANDS_SQL}, w as (select k, x0, case when x0 <= 4 then x0 - 4 when x0 <= 34 then 0 + (x0 - 4) * (40.0::double / 30) when x0 <= 72 then 40 + (x0 - 34) * (50.0::double / 38) when x0 <= 140 then 90 + (x0 - 72) * (60.0::double / 68) else x0 - 140 + 150 end::double as w,
  case when x0 <= 34 then 40 + (x0 - 34) * 0.25 when x0 <= 72 then 40 + (x0 - 34) * (50.0::double / 38) else 90 + (x0 - 72) * 0.25 end::double as t from stands)
select k, round(w, 6) as warped, round(coalesce([l for l in [{', '.join(map(str, _LINES))}]::double[] if abs(w - l) < 4][1], w), 6) as snapped, round(t, 6) as tailed from w""")
def legacy_axis_warp(spark, sf_dir):
    """Warps with tails of slope one and of another slope, and the first line within reach."""
    rows = venue.stands(spark, sf_dir).withColumn("w", legacy.axis_warp("x0", _KNOTS))
    return rows.select("k", F.round("w", 6).alias("warped"), F.round(legacy.quantise("w", _LINES), 6).alias("snapped"), F.round(legacy.axis_warp("x0", _KNOTS[1:3], 0.25), 6).alias("tailed"))


@query(f"""with {STANDS_SQL}, r as (select venue, "row", min(y0) + ("row" % 3) * 0.4 as y from stands group by 1, 2)
select venue, "row", round(min(y) over (partition by venue) + (row_number() over (partition by venue order by y, "row") - 1) * (4.2 + 10.0), 6) as target from r""")
def legacy_row_pitch(spark, sf_dir):
    """Rows at a uniform pitch from the first one down."""
    rows = venue.stands(spark, sf_dir).groupBy("venue", "row").agg(F.min("y0").alias("y0")).selectExpr("venue", "row", "y0 + (row % 3) * 0.4D as y")
    return legacy.row_pitch(rows, params.STREET_M, params.BAND_M).select("venue", "row", F.round("target", 6).alias("target"))


@query(f"""with {STANDS_SQL}, u as (select venue, k as ord, x0 + (k % 6) as x0, y0, x1 + (k % 6) as x1, y1 from stands where k % 2 = 1)
select u.venue, u.ord from u where not exists (select 1 from stands c where c.k % 2 = 0 and c.venue = u.venue and greatest(0, least(u.x1, c.x1) - greatest(u.x0, c.x0)) * greatest(0, least(u.y1, c.y1) - greatest(u.y0, c.y0)) / 36.0 > 0.6)""")
def legacy_overlap_dedupe(spark, sf_dir):
    s = venue.stands(spark, sf_dir)
    loose = s.where("k % 2 = 1").selectExpr("venue", "k as ord", "x0 + (k % 6) as x0", "y0", "x1 + (k % 6) as x1", "y1")
    return legacy.covered_anti(loose, s.where("k % 2 = 0")).select("venue", "ord")


@query(f"""with {STANDS_SQL}, l as (select k, k // 4 as rect, x0 as a, x0 + 2 + k % 3 as b, min(x0) over (partition by k // 4) as r0, max(x1) over (partition by k // 4) as r1 from stands)
select k, rect, coalesce((lag(b) over w + a) / 2, r0)::double as x0, coalesce((b + lead(a) over w) / 2, r1)::double as x1 from l window w as (partition by rect order by a, k)""")
def legacy_split_codes(spark, sf_dir):
    """A rectangle with several codes cut in the middle of the gaps between labels: end to start, not centres."""
    rows = venue.stands(spark, sf_dir).selectExpr("k", "k div 4 as rect", "x0 as a", "x0 + 2 + k % 3 as b", "min(x0) over (partition by k div 4) as r0", "max(x1) over (partition by k div 4) as r1")
    at = "over (partition by rect order by a, k)"
    return rows.selectExpr("k", "rect", f"coalesce((lag(b) {at} + a) / 2, r0) as x0", f"coalesce((b + lead(a) {at}) / 2, r1) as x1")


@query(f"""with {STANDS_SQL}, o as (select venue, k, x0 + 1 as x, y0 + (k % 9) as y from stands where k % 5 = 2), r as (select venue, k as rk, x0 as rx, y0 as ry from stands where k % 5 = 0),
p as (select o.venue, k, rk, (rx - x) * (rx - x) + 9 * (ry - y) * (ry - y) as d from o join r on r.venue = o.venue and abs(ry - y) <= 20 and abs(rx - x) <= 150), b as (select *, row_number() over (partition by venue, k order by d, rk) as n from p)
select venue, k, rk, d::double as d from b where n = 1""")
def legacy_row_adoption(spark, sf_dir):
    """Each loose stand adopts the row of the nearest reference, heights weighing three times."""
    s = venue.stands(spark, sf_dir)
    o = s.where("k % 5 = 2").selectExpr("venue", "k", "x0 + 1 as x", "y0 + (k % 9) as y").withColumn("band", F.explode(F.expr("sequence(cast(floor((y - 20) / 20) as int), cast(floor((y + 20) / 20) as int))")))
    r = s.where("k % 5 = 0").selectExpr("venue", "k as rk", "x0 as rx", "y0 as ry", "cast(floor(y0 / 20) as int) as band")
    pairs = o.join(r, ["venue", "band"]).where("abs(ry - y) <= 20 and abs(rx - x) <= 150").selectExpr("venue", "k", "rk", "(rx - x) * (rx - x) + 9 * (ry - y) * (ry - y) as d")
    return pairs.groupBy("venue", "k").agg(F.min(F.struct("d", "rk")).alias("m")).select("venue", "k", "m.rk", "m.d")


_TOKENS = """raw as (select doc_id as line, [x for x in regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+') if x <> ''] as ws from documents),
tok as (select line, unnest(range(1, len(ws) + 1)) as ord, unnest(ws) as w from raw), pos as (select line, ord, w, ord * 40 + length(w) % 9 * (ord % 4) as x0 from tok),
tokens as (select line, ord, w, x0::double as x0, (x0 + 12 + length(w))::double as x1 from pos)"""


@query(f"""with {_TOKENS}, s as (select *, x0 - lag(x1) over (partition by line order by x0, ord) as space from tokens),
f as (select *, case when space is null or space > 40 or length(w) <= 2 and space > 15 then 1 else 0 end as n from s), e as (select *, sum(n) over (partition by line order by x0, ord) as entry from f),
g as (select line, entry, string_agg(w, ' ' order by x0, ord) as name from e group by line, entry)
select line, max(entry)::bigint as entries, min(name) as first_name, count(distinct name) as names from g group by line""")
def legacy_directory_sessionise(spark, sf_dir):
    """Directory lines to entries: a code after a gap opens one, a wide gap ends it."""
    docs = venue.table(spark, sf_dir, "documents")
    tok = docs.select(F.col("doc_id").alias("line"), F.posexplode(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("p", "w")).selectExpr("line", "cast(p + 1 as long) as ord", "w")
    tok = tok.selectExpr("line", "ord", "w", "cast(ord * 40 + length(w) % 9 * (ord % 4) as double) as x0").selectExpr("*", "x0 + 12 + length(w) as x1")
    e = legacy.sessionise(tok, (F.length("w") <= 2) & (F.col("space") > 15), 40.0)
    names = e.groupBy("line", "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "ord", "w"))), lambda r: r["w"]), " ").alias("name"))
    return names.groupBy("line").agg(F.max("entry").alias("entries"), F.min("name").alias("first_name"), F.count_distinct("name").alias("names"))


_CELLS = """cellrows as (select k, "row", col as pos, case when k % 23 = 0 then 'Z' || substr(code, 2) else code end as code, left(code, 1) as letter, (col * 2 + case when k % 29 = 0 then -7 else 0 end)::bigint as number, (k % 15)::double as width from stands)"""


def cell_rows(spark, sf_dir):
    return venue.stands(spark, sf_dir).selectExpr("k", "row", "col as pos", "case when k % 23 = 0 then concat('Z', substring(code, 2)) else code end as code", "substring(code, 1, 1) as letter", "col * 2 + case when k % 29 = 0 then -7 else 0 end as number", "cast(k % 15 as double) as width")


_BREAKS = """st as (select *, number - lag(number) over (partition by "row" order by pos) as step from cellrows), dir as (select "row", sum(sign(step)) as s, count(*) as n from st group by "row"),
breaks as (select st."row", pos, number, step from st join dir on dir."row" = st."row" where n >= 3 and step is not null and case when s > 0 then step <= 0 else step >= 0 end)"""


@query(f"""with {STANDS_SQL}, {_CELLS}, {_BREAKS} select "row", pos, number, step from breaks""")
def legacy_sequence_check(spark, sf_dir):
    return legacy.sequence_breaks(cell_rows(spark, sf_dir))


@query(f"""with {STANDS_SQL}, {_CELLS}, {_BREAKS}, directory as (select distinct code from cellrows where k % 3 <> 0 union select 'X' || n from range(5) t(n)),
i as (select 'pending' as severity, 'V1' as rule, code || ' outside row ' || letter as msg from cellrows where left(code, 1) <> letter union all select 'warning', 'V2', 'row ' || "row" || ' breaks at ' || number from breaks
 union all select 'pending', 'V3', code || ' x' || count(*) from cellrows group by code having count(*) > 1 union all select 'warning', 'V4', code || ' has no name' from (select distinct code from cellrows) where code not in (select code from directory)
 union all select 'warning', 'V4', code || ' has no cell' from directory where code not in (select code from cellrows) union all select 'warning', 'V5', code || ' is ' || printf('%.1f', width) || ' m wide' from cellrows where width < 1 or width > 12)
select severity, rule, msg, count(*) as n from i group by all""")
def legacy_issue_report(spark, sf_dir):
    """All validation rules as one report."""
    c = cell_rows(spark, sf_dir)
    directory = c.where("k % 3 <> 0").select("code").union(spark.range(5).selectExpr("concat('X', id)")).distinct()
    return legacy.issues(c, directory).groupBy("severity", "rule", "msg").agg(F.count("*").alias("n"))


@query(f"""with recursive {STANDS_SQL}, c as (select "row" as block, x0 + 3 * (k % 2) as x0, x1 + 3 * (k % 2) as x1, case when k % 2 = 0 then 'top' else 'bottom' end as side, row_number() over (partition by "row" order by x0 + 3 * (k % 2), k) as n from stands),
f(block, n, col, x0, x1, sides) as (select block, n, 0, x0, x1, [side] from c where n = 1
  union all select block, n, case when fits then col else col + 1 end, case when fits then px0 else x0 end, case when fits then px1 else x1 end, case when fits then list_append(sides, side) else [side] end
  from (select c.*, f.col, f.x0 as px0, f.x1 as px1, f.sides, not list_contains(f.sides, c.side) and least(c.x1, f.x1) - greatest(c.x0, f.x0) > 0.5 * least(c.x1 - c.x0, f.x1 - f.x0) as fits from f join c on c.block = f.block and c.n = f.n + 1))
select block, max(col) as last_column, count(*) as n from f group by block""")
def legacy_column_pack(spark, sf_dir):
    """Cells in columns: the last column of each block and how many cells it holds."""
    rows = venue.stands(spark, sf_dir).selectExpr("row as block", "k as ord", "x0 + 3 * (k % 2) as x0", "x1 + 3 * (k % 2) as x1", "case when k % 2 = 0 then 'top' else 'bottom' end as side")
    return legacy.pack_columns(rows).groupBy("block").agg(F.max("column").alias("last_column"), F.count("*").alias("n"))


#: Bands of streets: one along each block of a row, three times as large, so that aisles are gaps and a lacking block a break.
_BANDS = """bands as (select venue, "row", "row" * 10 + col // 5 as ord, 3 * min(x0) as x0, 3 * max(x1) as x1, (3 * (min(y1) + 2) + (col // 5) * 0.4)::double as y from stands where not ("row" % 7 = 3 and col // 5 = 1) and ("row" % 11 <> 5 or col // 5 = 3) group by venue, "row", col // 5)"""
_GRAPH = f"""{_BANDS}, g as (select *, lag(x1) over w as prev, row_number() over w as nth, lead(ord) over w is null as final from bands window w as (partition by venue, "row" order by x0, ord)),
st as (select venue, "row", nth, unnest(case when prev is null then [{{k: 0, x: x0, j: false}}] when x0 - prev between 8 and 90 then [{{k: 0, x: (prev + x0) / 2, j: true}}] when x0 - prev > 90 then [{{k: 0, x: prev, j: true}}, {{k: 1, x: x0, j: false}}] else [] end) as s from g
  union all select venue, "row", nth, {{k: 9, x: x1, j: true}} from g where final),
me as (select venue, "row", avg(y) as y, min(x0) as west, arg_max(x1, (x0, ord)) as east from bands group by 1, 2),
pl as (select st.venue, st."row", nth, s.k as k, round(s.x, 1) as x, s.j as joined, round(me.y, 1) as y from st join me on me.venue = st.venue and me."row" = st."row"),
be as (select *, lag(x) over (partition by venue, "row" order by nth, k) as px from pl), nodes as (select distinct venue, "row", x, y from pl),
ra as (select *, (west + east) / 2 >= 300 as part, row_number() over (partition by venue, (west + east) / 2 >= 300 order by y, "row") as rank from me),
pr as (select a.venue, a."row", b."row" as row2 from ra a join ra b on b.venue = a.venue and b.part = a.part and b.rank = a.rank + 1 where least(a.east, b.east) - greatest(a.west, b.west) >= 40 and b.y - a.y <= 120),
cl as (select n.venue, n.x, n.y, m.x as bx, m.y as b_y, row_number() over (partition by n.venue, n."row", n.x, n.y order by abs(m.x - n.x), m.x, m.y) as r from nodes n join pr on pr.venue = n.venue and pr."row" = n."row" join nodes m on m.venue = n.venue and m."row" = pr.row2 where abs(m.x - n.x) < 18),
ed as (select venue, px as ax, y as ay, x as bx, y as b_y from be where joined and px is not null union all select venue, x, y, bx, b_y from cl where r = 1)"""


@query(f"""with {STANDS_SQL}, {_GRAPH}
select distinct venue, case when (ax, ay) <= (bx, b_y) then ax else bx end as ax, case when (ax, ay) <= (bx, b_y) then ay else b_y end as ay, case when (ax, ay) <= (bx, b_y) then bx else ax end as bx, case when (ax, ay) <= (bx, b_y) then b_y else ay end as "by" from ed where (ax, ay) <> (bx, b_y)""")
def legacy_corridor_graph(spark, sf_dir):
    """Undirected edges of the street graph."""
    s = venue.stands(spark, sf_dir).withColumn("block", F.expr("cast(col div 5 as int)")).where("not (row % 7 = 3 and block = 1) and (row % 11 <> 5 or block = 3)")
    bands = s.groupBy("venue", "row", "block").agg((3 * F.min("x0")).alias("x0"), (3 * F.max("x1")).alias("x1"), (3 * (F.min("y1") + 2)).alias("y")).selectExpr("venue", "row", "row * 10 + block as ord", "x0", "x1", "y + block * 0.4D as y")
    return legacy.corridor_graph(bands, 300.0)[1]


@query(f"""with {STANDS_SQL}, w as (select venue, k as word, name as t, x0 + (k % 9) as x, y0 + (k % 8) as y from stands), r as (select venue, k, x0, y0, x1, y1, case when k % 4 = 0 then 7.0 else 9.0 end as side, r, g, b from stands)
select r.venue, r.k, count(word) as words from r left join w on w.venue = r.venue and w.x between r.x0 - 1 and r.x1 + 1 and w.y between r.y0 - 1 and r.y1 + 1 where not (side < 8 and greatest(r, g, b) - least(r, g, b) <= 55) group by r.venue, r.k""")
def legacy_words_in_rect(spark, sf_dir):
    """Words inside each padded rectangle; rectangles that are decoration by size and chroma are left out."""
    from atrium.operators.labels import cell_of, cells_of_box

    s = venue.stands(spark, sf_dir)
    rect = s.where("not (case when k % 4 = 0 then 7.0 else 9.0 end < 8 and greatest(r, g, b) - least(r, g, b) <= 55)").select("venue", "k", "x0", "y0", "x1", "y1")
    words = s.selectExpr("venue", "k as word", "x0 + (k % 9) as x", "y0 + (k % 8) as y").withColumn("cell", cell_of("x", "y"))
    hits = rect.withColumn("cell", F.explode(cells_of_box("x0", "y0", "x1", "y1", 1.0))).join(words, ["venue", "cell"]).where("x between x0 - 1 and x1 + 1 and y between y0 - 1 and y1 + 1")
    n = hits.groupBy("venue", "k").agg(F.count("*").alias("words"))
    return rect.select("venue", "k").join(n, ["venue", "k"], "left").select("venue", "k", F.coalesce("words", F.lit(0)).alias("words"))


@query(f"""with {STANDS_SQL}, h as (select venue, k, left(code, 1) as t, x0 + 2 as x, y0 + 2 as y from stands), d as (select venue, k as dk, substr(code, 2) as dt, x0 + 2 + (k % 6) as dx, y0 + 2 + (k % 5) as dy from stands),
p as (select h.venue, k, dk, t || dt as code, row_number() over (partition by h.venue, k order by dk) as n from h join d on d.venue = h.venue and abs(dx - x) <= 4 and dy - y between -3 and 4)
select venue, k, code, 'TI' || lpad((k % 31)::varchar, 2, '0') as fused_a, 'TI' || lpad((k % 31 + 1)::varchar, 2, '0') as fused_b from p where n = 1""")
def legacy_compose_codes(spark, sf_dir):
    """A letter and the digits beneath it make a code; two fused codes come apart."""
    s = venue.stands(spark, sf_dir)
    bucket = lambda c: f"cast(floor({c} / 16) as int)"
    h = s.selectExpr("venue", "k", "substring(code, 1, 1) as t", "x0 + 2 as x", "y0 + 2 as y").withColumn("i", F.explode(F.expr("sequence(cast(floor((x - 4) / 16) as int), cast(floor((x + 4) / 16) as int))"))).withColumn("j", F.explode(F.expr("sequence(cast(floor((y - 4) / 16) as int), cast(floor((y + 4) / 16) as int))")))
    d = s.selectExpr("venue", "k as dk", "substring(code, 2) as dt", "x0 + 2 + (k % 6) as dx", "y0 + 2 + (k % 5) as dy").selectExpr("*", f"{bucket('dx')} as i", f"{bucket('dy')} as j")
    first = h.join(d, ["venue", "i", "j"]).where("abs(dx - x) <= 4 and dy - y between -3 and 4").groupBy("venue", "k", "t").agg(F.min(F.struct("dk", "dt")).alias("m"))
    fused = F.concat(F.lit("TI"), F.lpad((F.col("k") % 31).cast("string"), 2, "0"), F.lit("TI"), F.lpad((F.col("k") % 31 + 1).cast("string"), 2, "0"))
    part = lambda n: F.regexp_extract(fused, r"^([A-Z]{2}\d{2})([A-Z]{2}\d{2})$", n)
    return first.select("venue", "k", F.concat("t", "m.dt").alias("code"), part(1).alias("fused_a"), part(2).alias("fused_b"))


@query(f"""with recursive {STANDS_SQL}, w as (select venue, k as ord, x0 as x, y0 as y, row_number() over (partition by venue order by k) as n from stands where k % 3 = 0), c as (select venue, code, x0 as x, y0 as y from stands where k % 3 = 1),
p as materialized (select w.venue, w.n, c.code, sqrt(power(c.x - w.x, 2) + power(c.y - w.y, 2)) as d from w join c on c.venue = w.venue and c.x between w.x - 10 and w.x + 10 and c.y between w.y - 10 and w.y + 10 where sqrt(power(c.x - w.x, 2) + power(c.y - w.y, 2)) <= 10),
t(venue, n, used, code) as (select distinct venue, 0::bigint, []::varchar[], null::varchar from w
  union all select venue, n + 1, case when code is null then used else list_append(used, code) end, code
  from (select t.venue, t.n, any_value(t.used) as used, arg_min(p.code, (p.d, p.code)) filter (where not list_contains(t.used, p.code)) as code from t join w on w.venue = t.venue and w.n = t.n + 1 left join p on p.venue = t.venue and p.n = t.n + 1 group by t.venue, t.n))
select w.venue, w.ord, t.code from t join w on w.venue = t.venue and w.n = t.n where t.code is not null""")
def legacy_nearest_unused_code(spark, sf_dir):
    """Each shape in order takes the nearest code that none before it took."""
    s = venue.stands(spark, sf_dir)
    return legacy.nearest_unused(s.where("k % 3 = 0").selectExpr("venue", "k as ord", "x0 as x", "y0 as y"), s.where("k % 3 = 1").selectExpr("venue", "code", "x0 as x", "y0 as y"))


@query()
def legacy_weld(spark, sf_dir):
    """Gaps closed along the rows, then along the columns."""
    s = venue.stands(spark, sf_dir).selectExpr("venue * 1000 + row % 1000 as row", "venue * 100 + col as column", "k as ord", "x0", "y0", "x1 - 0.5D * (k % 3) as x1", "y1")
    both = legacy.weld(legacy.weld(s), by="column", axis="y")
    return both.groupBy("row").agg(F.round(F.sum(F.expr("x1 - x0")), 6).alias("width"), F.round(F.sum(F.expr("y1 - y0")), 6).alias("height"), F.count("*").alias("n"))


#: Halls of ten rows each; their streets lean, their aisles are of two widths, and some streets aren't of the hall.
_HALL = """hall as (select "row" // 10 as venue, k, col, "row" % 10 as r, x0 * 3 as x0, (60 * ("row" % 10) + 20)::double as y0, x1 * 3 as x1, (60 * ("row" % 10) + 55)::double as y1 from stands),
road as (select venue, r, 'RUA ' || r as name, min(x0) + r % 3 * 0.37 as x0, 60 * r + 1 + (col // 5) * 0.25 as y0, max(x1) - r % 2 as x1 from hall group by venue, r, col // 5
  union all select venue, r, null, 100.0, 60 * r + 38.0, 110.0 from hall where col = 0 union all select venue, r, 'RUA Z', 1020.0, 60 * r + 38.0, 1030.0 from hall where col = 0)"""


@query(f"""with {STANDS_SQL}, {_HALL}, rd as (select *, round_even(y0 / 10, 0) as band from road where name is not null and x0 < 1015), rw as (select venue, band, avg(y0) as y from rd group by venue, band),
rn as (select *, row_number() over (partition by venue order by y) - 1 as i, min(y) over (partition by venue) as f from rw),
yk as (select venue, y + u as old, f + i * 57 + u as new from rn, (values (0), (17)) t(u)), gp as (select venue, x1 as w, lead(x0) over (partition by venue, band order by x0) as e from rd),
gm as (select venue, w, e, (w + e) / 2 as m from gp where e - w > 5 and e - w < 60), go as (select *, case when m - lag(m) over (partition by venue order by m, w, e) < 12 then 0 else 1 end as o from gm),
gc as (select *, sum(o) over (partition by venue order by m, w, e rows unbounded preceding) as c from go), ga as (select venue, c, avg(w) as w, avg(m) as m, avg(e) as e from gc group by venue, c),
xk as (select venue, w as old, m - 10 as new from ga union all select venue, e, m + 10 from ga),
kn as (select 'x' as axis, venue, old, new from xk union all select 'y', venue, old, new from yk), sg as (select *, lead(old) over w as old2, lead(new) over w as new2, row_number() over w as nth from kn window w as (partition by axis, venue order by old)),
va as (select venue, k, 'x0' as side, 'x' as axis, x0 as v from hall union all select venue, k, 'y0', 'y', y0 from hall union all select venue, k, 'x1', 'x', x1 from hall union all select venue, k, 'y1', 'y', y1 from hall),
wv as (select va.venue, k, side, case when nth = 1 and v <= old then v + new - old when old2 is null then v + new - old else new + (v - old) / (old2 - old) * (new2 - new) end as v from va join sg on sg.venue = va.venue and sg.axis = va.axis and (v > old and (old2 is null or v <= old2) or nth = 1 and v <= old))
select venue, k, round(max(case when side = 'x0' then v end), 2) as x0, round(max(case when side = 'y0' then v end), 2) as y0, round(max(case when side = 'x1' then v end), 2) as x1, round(max(case when side = 'y1' then v end), 2) as y1 from wv group by venue, k""")
def legacy_straighten(spark, sf_dir):
    """Shapes on the regular grid of their hall's ten rows of streets and its aisles."""
    s = venue.stands(spark, sf_dir).selectExpr("row div 10 as venue", "k", "col", "row % 10 as r", "x0 * 3 as x0", "cast(60 * (row % 10) + 20 as double) as y0", "x1 * 3 as x1", "cast(60 * (row % 10) + 55 as double) as y1")
    roads = s.groupBy("venue", "r", F.expr("col div 5 as b")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).selectExpr("venue", "concat('RUA ', r) as name", "x0 + r % 3 * 0.37D as x0", "60 * r + 1 + b * 0.25D as y0", "x1 - r % 2 as x1")
    other = s.where("col = 0").selectExpr("venue", "inline(array(struct(cast(null as string) as name, 100D as x0, 60 * r + 38D as y0, 110D as x1), struct('RUA Z' as name, 1020D as x0, 60 * r + 38D as y0, 1030D as x1)))")
    return legacy.straighten(s.select("venue", "k", "x0", "y0", "x1", "y1"), roads.unionByName(other))


@query()
def legacy_layout_pipeline(spark, sf_dir):
    """Warp, snap to lines, weld, fit highlights to their band: the older layout in one pass."""
    s = venue.stands(spark, sf_dir).withColumns({"x0": legacy.axis_warp("x0", _KNOTS), "x1": legacy.axis_warp("x1", _KNOTS)})
    s = s.withColumns({"x0": legacy.quantise("x0", _LINES, 1.0), "x1": legacy.quantise("x1", _LINES, 1.0)})
    bands = s.groupBy("venue", F.col("row").alias("band")).agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"))
    kind = F.expr("case p_type when 'MEDIUM' then 'patrocinador' when 'PROMO' then 'entidade' else 'expositor' end").alias("cat")
    welded = legacy.weld(s.select("venue", "row", F.col("k").alias("ord"), kind, "x0", F.expr("y0 + case when p_type = 'MEDIUM' then -1.4D else 0D end").alias("y0"), "x1", "y1"))
    fitted = legacy.fit_highlights(welded, bands)
    return fitted.select("row", "ord", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


_BANDED = """bd as (select venue, "row" as band, min(y0) as top, max(y1) as bottom from stands group by 1, 2), hi as (select venue, k as ord, "row" as band, case when p_type = 'MEDIUM' then 'patrocinador' when p_type = 'PROMO' then 'entidade' else 'expositor' end as cat, x0 + case when k % 2 = 0 then 0.5 else 0.0 end as x0, y0 + case when p_type in ('MEDIUM', 'PROMO') then -1.4 else 0.5 end as y0, x1, y1 - case when p_type in ('MEDIUM', 'PROMO') then 2.0 else 0.0 end as y1 from stands)"""


@query(f"""with {STANDS_SQL}, {_BANDED}, e as (select venue, band, round(y0, 1) as a, round(y1, 1) as b from hi where cat = 'expositor'),
m as (select bd.venue, bd.band, coalesce(ea.a, top) as top, coalesce(ea.b, bottom) as bottom from bd left join (select distinct venue, band, a, b from e) ea on ea.venue = bd.venue and ea.band = bd.band),
f as (select h.venue, h.ord, h.x0, h.x1, m.top as y0, m.bottom as y1 from hi h join m on m.venue = h.venue and m.band = h.band where cat <> 'expositor'),
n as (select f.venue, f.ord, max(case when f.x0 - o.x1 > 0 and f.x0 - o.x1 < 5 then o.x1 end) as west, min(case when o.x0 - f.x1 > 0 and o.x0 - f.x1 < 5 then o.x0 end) as east from f join hi o on o.venue = f.venue and o.ord <> f.ord and least(f.y1, o.y1) - greatest(f.y0, o.y0) >= 0.5 * (f.y1 - f.y0) group by 1, 2)
select h.venue, h.ord, round(coalesce(n.west, h.x0), 6) as x0, round(coalesce(f.y0, h.y0), 6) as y0, round(coalesce(n.east, h.x1), 6) as x1, round(coalesce(f.y1, h.y1), 6) as y1 from hi h left join f on f.ord = h.ord left join n on n.ord = h.ord""")
def legacy_highlights(spark, sf_dir):
    """Highlighted cells take their band's usual height and meet their neighbours."""
    s = venue.stands(spark, sf_dir)
    bands = s.groupBy("venue", F.col("row").alias("band")).agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"))
    cells = s.selectExpr("venue", "k as ord", "case p_type when 'MEDIUM' then 'patrocinador' when 'PROMO' then 'entidade' else 'expositor' end as cat", "x0 + case when k % 2 = 0 then 0.5D else 0D end as x0", "y0 + case when p_type in ('MEDIUM', 'PROMO') then -1.4D else 0.5D end as y0", "x1", "y1 - case when p_type in ('MEDIUM', 'PROMO') then 2D else 0D end as y1")
    return legacy.fit_highlights(cells, bands).select("venue", "ord", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"""with {STANDS_SQL}, l as (select venue, k, left(code, 1) as name, x0, y0, x1, y1, (y0 + y1) / 2 as ly from stands where k % 3 = 0), m as (select venue, k, left(code, 1) as name, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy from stands where k % 3 = 1),
s as (select m.venue, m.k, l.y0, l.y1, row_number() over (partition by m.venue, m.k order by abs(l.ly - m.cy), l.k) as n from m join l on l.venue = m.venue and l.name = m.name),
c as (select m.venue, m.k, l.x0, l.x1, row_number() over (partition by m.venue, m.k order by abs(l.ly - m.cy), l.k) as n from m join l on l.venue = m.venue and m.cx between l.x0 and l.x1)
select m.venue, m.k as ord, m.name, c.x0, s.y0, c.x1, s.y1 from m join s on s.venue = m.venue and s.k = m.k and s.n = 1 join c on c.venue = m.venue and c.k = m.k and c.n = 1""")
def legacy_lane_synthesis(spark, sf_dir):
    """A lane for each name that stands alone: as high as its nearest sibling, as wide as the nearest lane of its column."""
    s = venue.stands(spark, sf_dir).selectExpr("venue", "k", "substring(code, 1, 1) as name", "x0", "y0", "x1", "y1")
    lanes = s.where("k % 3 = 0").withColumnRenamed("k", "lane")
    return legacy.synthetic_lanes(s.where("k % 3 = 1").selectExpr("venue", "k as ord", "name", "(x0 + x1) / 2 as cx", "(y0 + y1) / 2 as cy"), lanes)


@query(f"""with {STANDS_SQL}, e as (select k, x0 + 0.3 * (k % 7) as a, x1 - 0.2 * (k % 5) as b from stands), g as (select unnest([0.0, 7.0, 14.0, 21.0, 28.0, 35.0, 42.0, 49.0, 56.0, 63.0, 70.0, 77.0, 84.0, 91.0, 98.0, 105.0, 112.0, 119.0, 126.0, 133.0, 140.0]::double[]) as l),
f as (select k, a, b, arg_min(l, (abs(l - a), l)) as l0 from e, g group by all), s as (select k, a, b, l0, arg_min(l, (abs(l - b), l)) as l1 from f, g where l > l0 group by all)
select k, case when (l1 - l0) / (b - a) between 0.72 and 1.38 and abs((l0 + l1) / 2 - (a + b) / 2) <= 15 then l0 else round(a, 6) end as x0, case when (l1 - l0) / (b - a) between 0.72 and 1.38 and abs((l0 + l1) / 2 - (a + b) / 2) <= 15 then l1 else round(b, 6) end as x1 from s""")
def legacy_edge_snap(spark, sf_dir):
    """Both edges to the nearest lines, the second beyond the first; too large a change is refused."""
    rows = venue.stands(spark, sf_dir).selectExpr("k", "x0 + 0.3D * (k % 7) as a", "x1 - 0.2D * (k % 5) as b", "transform(sequence(0, 20), i -> i * 7.0D) as lines")
    rows = rows.selectExpr("*", "array_min(transform(lines, l -> struct(abs(l - a) as d, l))).l as l0").selectExpr("*", "array_min(transform(filter(lines, l -> l > l0), l -> struct(abs(l - b) as d, l))).l as l1")
    fine = "l1 is not null and (l1 - l0) / (b - a) between 0.72 and 1.38 and abs((l0 + l1) / 2 - (a + b) / 2) <= 15"
    return rows.selectExpr("k", f"case when {fine} then l0 else round(a, 6) end as x0", f"case when {fine} then l1 else round(b, 6) end as x1")


@query(f"""with {STANDS_SQL}, b as (select venue, "row" as band, min(y0) as lo, max(y1) as hi from stands group by venue, "row"), p as (select venue, k, y0 + (k % 14) as cy from stands),
m as (select k, band, row_number() over (partition by k order by band) as n from p join b on b.venue = p.venue and cy between lo - 3 and hi + 3)
select p.k, m.band from p left join m on m.k = p.k and n = 1""")
def legacy_band_lookup(spark, sf_dir):
    """The first band whose range, three wider on both sides, holds a height."""
    s = venue.stands(spark, sf_dir)
    bands = s.groupBy("venue", F.col("row").alias("band")).agg(F.min("y0").alias("lo"), F.max("y1").alias("hi")).withColumn("m", F.explode(F.expr("sequence(cast(floor(lo - 3) as int), cast(ceil(hi + 3) as int))")))
    p = s.selectExpr("venue", "k", "y0 + (k % 14) as cy").withColumn("m", F.floor("cy").cast("int"))
    hit = p.join(bands, ["venue", "m"]).where("cy between lo - 3 and hi + 3").groupBy("k").agg(F.min("band").alias("band"))
    return p.select("k").join(hit, "k", "left")


@query(f"""with recursive {STANDS_SQL}, a as (select venue, k // 4 as f, k as ord, x0 as x, y0 + (k % 2) * 3 as y, row_number() over (partition by venue, k // 4 order by k) as n from stands),
r(venue, f, n, ord, kept, dup) as (select venue, f, n, ord, [{{o: ord, x: x, y: y}}], null::bigint from a where n = 1 union all
  select a.venue, a.f, a.n, a.ord, case when len([b.o for b in r.kept if abs(b.x - a.x) < 8 and abs(b.y - a.y) < 8]) > 0 then r.kept else list_append(r.kept, {{o: a.ord, x: a.x, y: a.y}}) end, [b.o for b in r.kept if abs(b.x - a.x) < 8 and abs(b.y - a.y) < 8][1]
  from r join a on a.venue = r.venue and a.f = r.f and a.n = r.n + 1)
select venue, ord, dup as of from r where dup is not null""")
def legacy_fuzzy_dupes(spark, sf_dir):
    """Areas of one name that lie beside one that stays: what goes makes nothing else go."""
    rows = venue.stands(spark, sf_dir).selectExpr("venue", "k as ord", "concat(case when k % 2 = 0 then 'Praça ' else 'PRAÇA ' end, k div 4) as name", "x0 as x", "y0 + (k % 2) * 3 as y")
    return legacy.fuzzy_duplicates(rows)


@query(f"""with {STANDS_SQL}, e as (select k, unnest([code, code || 'B', code || 'C']) as code, unnest([0, 1, 2]) as nth, x0 + 3 as x, y0 + 3 as y from stands where k % 10 = 0), known as (select distinct code from stands where k % 20 = 0 union all select code || 'C' from stands where k % 30 = 0)
select k, code, x - 6 as x0, y - 6 as y0, x + 6 as x1, y + 6 as y1 from e where nth > 0 and code not in (select code from known)""")
def legacy_sub_areas(spark, sf_dir):
    """Extra codes of a shape that the directory doesn't know become areas around their label."""
    s = venue.stands(spark, sf_dir)
    extra = s.where("k % 10 = 0").select("k", F.posexplode(F.array("code", F.concat("code", F.lit("B")), F.concat("code", F.lit("C")))).alias("nth", "code"), (F.col("x0") + 3).alias("x"), (F.col("y0") + 3).alias("y")).where("nth > 0")
    known = s.where("k % 20 = 0").select("code").union(s.where("k % 30 = 0").select(F.concat("code", F.lit("C")))).distinct()
    return extra.join(known, "code", "left_anti").selectExpr("k", "code", "x - 6 as x0", "y - 6 as y0", "x + 6 as x1", "y + 6 as y1")


@query(f"""with {STANDS_SQL}, e as (select "row", k, round(y0 + (k % 3) * 0.1, 1) as edge from stands), c as (select "row", edge, count(*) as n, min(k) as f from e group by 1, 2), m as (select *, row_number() over (partition by "row" order by n desc, f) as nth from c),
d as (select venue, code, count(*) as n, arg_min(k, ((6 + k % 5) * (6 + k % 3), k)) as kept from stands group by venue, code)
select m."row", m.edge as mode_edge, count(*) filter (where s.k = d.kept) as keeps, count(*) filter (where d.n > 1) as in_dupes from m join stands s on s."row" = m."row" join d on d.venue = s.venue and d.code = s.code where nth = 1 group by m."row", m.edge""")
def legacy_mode_and_dupes(spark, sf_dir):
    """The most frequent edge of each row, and how many of its shapes keep a code: the smallest that claims it."""
    s = venue.stands(spark, sf_dir)
    counts = s.selectExpr("row", "k", "round(y0 + (k % 3) * 0.1D, 1) as edge").groupBy("row", "edge").agg(F.count("*").alias("n"), F.min("k").alias("f"))
    mode = counts.groupBy("row").agg(F.min(F.struct((-F.col("n")).alias("n"), "f", "edge")).alias("m")).select("row", F.col("m.edge").alias("mode_edge"))
    kept = legacy.keep_smallest(s.selectExpr("venue", "row", "k as ord", "code", "code as claimed", "x0", "y0", "x1 + k % 5 as x1", "y1 + k % 3 as y1"))
    dupes = s.groupBy("venue", F.col("code").alias("claimed")).agg(F.count("*").alias("n"))
    rows = kept.join(dupes, ["venue", "claimed"]).groupBy("row").agg(F.count("code").alias("keeps"), F.count_if(F.expr("n > 1")).alias("in_dupes"))
    return mode.join(rows, "row")


@query(f"""with recursive {STANDS_SQL}, c as (select venue, k, y0 + (k % 13) * 0.7 as cy, x0, x1 from stands), h as (select venue, cy, count(*) as n, row_number() over (partition by venue order by cy) as nth from c group by venue, cy),
r(venue, nth, cy, line, s, n) as (select venue, nth, cy, 0, cy * n, n from h where nth = 1 union all select h.venue, h.nth, h.cy, case when abs(r.s / r.n - h.cy) <= 4 then r.line else r.line + 1 end, case when abs(r.s / r.n - h.cy) <= 4 then r.s else 0 end + h.cy * h.n, case when abs(r.s / r.n - h.cy) <= 4 then r.n else 0 end + h.n
  from r join h on h.venue = r.venue and h.nth = r.nth + 1)
select c.venue, r.line::int as line, count(*) as n, min(x0) as x0, max(x1) as x1, round(avg(c.cy), 6) as centre from c join r on r.venue = c.venue and r.cy = c.cy group by c.venue, r.line""")
def legacy_row_cluster(spark, sf_dir):
    """Rows of heights near their running mean, and their extents."""
    rows = venue.stands(spark, sf_dir).selectExpr("venue", "k", "y0 + (k % 13) * 0.7D as y", "x0", "x1")
    return legacy.clustered_rows(rows, 4.0).groupBy("venue", "line").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.round(F.avg("y"), 6).alias("centre"))


@query(f"""with {STANDS_SQL} select venue, min(x0) - 4 as x0, min(y0) - 4 as y0, max(x1) + 4 as x1, max(y1) + 4 as y1 from stands where x0 > 100 and k % 3 = 0 group by venue""")
def legacy_annex(spark, sf_dir):
    """The floor under what stands in the annex."""
    return legacy.annex_box(venue.stands(spark, sf_dir).where("k % 3 = 0"), 100.0)


@query(f"""with {STANDS_SQL}, c as (select r, g, b, count(*) as n, list_sort(list(price))[count(*) // 2 + 1] as median_price, max(price) - min(price) as spread from stands group by r, g, b)
select * from (select *, row_number() over (order by n desc, r, g, b) as pos from c) where pos <= 20""")
def legacy_colour_census(spark, sf_dir):
    """The twenty most frequent fills with the upper median and range of a measure."""
    # Counted by value first: what is ranked inside a fill is a row per distinct measure.
    counts = venue.stands(spark, sf_dir).groupBy("r", "g", "b", "price").agg(F.count("*").alias("m"))
    order = "partition by r, g, b order by price"
    ranked = counts.selectExpr("*", f"sum(m) over ({order}) as upto", "sum(m) over (partition by r, g, b) as n")
    rows = ranked.groupBy("r", "g", "b").agg(F.max("n").alias("n"), F.min(F.expr("case when upto > n div 2 then price end")).alias("median_price"), F.expr("max(price) - min(price)").alias("spread"))
    top = rows.orderBy(F.desc("n"), "r", "g", "b").limit(20)
    return top.selectExpr("*", "row_number() over (order by n desc, r, g, b) as pos")


@query(f"""with {STANDS_SQL}, g as (select *, max(x1) over (partition by "row" order by x0, ord rows between unbounded preceding and 1 preceding) as reach from stands), b as (select *, sum(case when x0 - reach > 2 then 1 else 0 end) over (partition by "row" order by x0, ord) as block from g),
s as (select "row", block::int as block, count(*) as n, sum(x1 - x0) as width from b group by 1, 2)
select "row", block, n, width, coalesce(sum(width + 4) over (partition by "row" order by block rows between unbounded preceding and 1 preceding), 0)::double as "offset" from s""")
def legacy_gap_blocks(spark, sf_dir):
    """Blocks between aisles and where each starts when packed at four metres apart."""
    b = legacy.gap_blocks(venue.stands(spark, sf_dir), 2.0).groupBy("row", "block").agg(F.count("*").alias("n"), F.sum(F.expr("x1 - x0")).alias("width"))
    return b.selectExpr("row", "block", "n", "width", "coalesce(sum(width + 4) over (partition by row order by block rows between unbounded preceding and 1 preceding), 0D) as offset")


@query(f"""with {STANDS_SQL}, l as (select k, case when k % 7 = 0 then 'K20 K18' when k % 7 = 1 then 'VAN  SP TURIS EXT02' when k % 7 = 2 then name || ' de faber-castell' when k % 7 = 3 then name || ' um dois tres quatro cinco' when k % 7 = 4 then 'a nova PIZZA HUT do hall dois ao lado' when k % 7 = 5 then 'TI01 TI02 TI03' else 'loja ' || k end as label,
  case when k % 2 = 0 and k % 7 in (4, 6) then code end as code, case when k % 14 = 6 then 'EDITORA e CIA' when k % 14 = 13 then '' end as entry from stands),
w as (select *, [x for x in regexp_split_to_array(trim(label), '\\s+') if not regexp_matches(x, '^[A-Z]{{1,3}}[0-9]{{1,3}}[A-Z]?$')] as ws0 from l),
t as (select k, label, code, entry, [lower(x) for x in case when coalesce(entry, '') <> '' then regexp_split_to_array(entry, ' ') else ws0 end] as ws, regexp_matches(array_to_string(ws0, ' '), '(?i)PIZZA HUT|JOHNNY|SPOLETO|BOALI|BAUDUCCO|LOCKERS|INDIGO') as restaurant from w)
select k, case when coalesce(entry, '') = '' and starts_with(label, 'TI01') then 'Alameda dos Artistas' when coalesce(entry, '') <> '' or restaurant or len(ws) between 1 and 4 and code is null then array_to_string([case when i > 1 and ws[i] in ('de', 'da', 'do', 'das', 'dos', 'e', 'em', 'a', 'o', 'à', 'por') then ws[i] else array_to_string([upper(p[1:1]) || p[2:] for p in string_split(ws[i], '-')], '-') end for i in range(1, len(ws) + 1)], ' ') end as area_name,
  not exists (select 1 from stands s where s.k = t.k + 1) as last_number from t""")
def legacy_text_cleanup(spark, sf_dir):
    """Area names out of labels and the directory, and the numbers after which the sequence stops."""
    s = venue.stands(spark, sf_dir)
    rows = s.selectExpr(
        "k", "case k % 7 when 0 then 'K20 K18' when 1 then 'VAN  SP TURIS EXT02' when 2 then concat(name, ' de faber-castell') when 3 then concat(name, ' um dois tres quatro cinco') when 4 then 'a nova PIZZA HUT do hall dois ao lado' when 5 then 'TI01 TI02 TI03' else concat('loja ', k) end as label",
        "case when k % 2 = 0 and k % 7 in (4, 6) then code end as code", "case k % 14 when 6 then 'EDITORA e CIA' when 13 then '' end as entry",
    )
    last = s.select("k").join(s.selectExpr("k - 1 as k"), "k", "left_anti").withColumn("last_number", F.lit(True))
    return rows.select("k", legacy.area_name("label", "code", "entry").alias("area_name")).join(last, "k", "left").withColumn("last_number", F.coalesce("last_number", F.lit(False)))


_SHAPED = """sh as (select venue, k, (x0 * 11)::double as x0, (80 + (k * 37 % 950))::double as y0, (x0 * 11 + k % 40)::double as x1, (80 + (k * 37 % 950) + 3 + k % 60)::double as y1, r + k % 8 as r, g, b - k % 5 as b, k % 6 = 0 as has_text from stands),
sx as (select *, x1 - x0 as w, y1 - y0 as h, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy, (x1 - x0) * (y1 - y0) as area from sh)"""


def _colour_sql(table, tol):
    return " ".join(f"when abs(r - {c[0]}) <= {tol} and abs(g - {c[1]}) <= {tol} and abs(b - {c[2]}) <= {tol} then '{name}'" for c, name in table)


@query(f"""with {STANDS_SQL}, {_SHAPED}, q as (select *, case k % 4 when 0 then 198 when 1 then 128 when 2 then 250 else r end as r2, case k % 4 when 0 then 199 when 1 then 129 when 2 then 160 else g end as g2, case k % 4 when 0 then 196 when 1 then 129 when 2 then 30 else b end as b2 from sx),
z as (select * exclude (r, g, b), r2 as r, g2 as g, b2 as b from q),
c as (select *, case {_colour_sql(params.LEGACY_STANDS, 10)} {_colour_sql(params.LEGACY_AREAS, 10)} when abs(r - 198) <= 6 and abs(g - 199) <= 6 and abs(b - 200) <= 6 and area > 2000 then 'externo' end as cat,
  w between 3.5 and 11 and h between 15 and 85 and cx < 215 and greatest(r, g, b) - least(r, g, b) > 55 as marker from z)
select k, w >= 5 and h >= 5 and not (cx between 1075 and 1587.4 and cy between 285 and 490) and y0 < 950 and y0 > 105 and not (cx > 1270 and cy < 300) as on_map, cat, marker,
  not has_text and not coalesce(case when marker then 'marcador' else cat end in ('marcador', 'externo'), false) and (least(w, h) < 8 or area < 600) as decoration from c""")
def legacy_shape_filters(spark, sf_dir):
    """What belongs to the plan, its category by colour, markers and decoration."""
    s = venue.stands(spark, sf_dir).selectExpr("k", "cast(x0 * 11 as double) as x0", "cast(80 + (k * 37 % 950) as double) as y0", "cast(x0 * 11 + k % 40 as double) as x1", "cast(80 + (k * 37 % 950) + 3 + k % 60 as double) as y1", "r + k % 8 as r", "g", "b - k % 5 as b", "k % 6 = 0 as has_text")
    of = lambda own, *others: F.expr("case k % 4 " + " ".join(f"when {n} then {v}" for n, v in enumerate(others)) + f" else {own} end")
    s = s.withColumns({"r": of("r", 198, 128, 250), "g": of("g", 199, 129, 160), "b": of("b", 196, 129, 30)})
    s = s.selectExpr("*", "x1 - x0 as w", "y1 - y0 as h", "(x0 + x1) / 2 as cx", "(x1 - x0) * (y1 - y0) as area").withColumn("found", legacy.colour_kind())
    s = s.withColumn("marker", legacy.is_marker()).withColumn("cat", F.when(F.col("marker"), "marcador").otherwise(F.col("found")))
    return s.select("k", legacy.on_map().alias("on_map"), F.col("found").alias("cat"), "marker", legacy.is_decoration(F.col("has_text")).alias("decoration"))


@query(f"""with {STANDS_SQL}, t as (select k, case when k % 3 = 0 then (36 - (k % 4) * (k % 4)) / 36.0 else 1.0 end as ratio, case when k % 3 = 0 then 6 else 4 end as n, k % 7 = 0 as snapped from stands)
select k, round(ratio, 6)::double as ratio, case when snapped or n <= 5 or ratio > 0.92 then 4 else 6 end as n_points from t""")
def legacy_flatten_rings(spark, sf_dir):
    """Shapes that nearly fill their box become it; an L stays one."""
    s = venue.stands(spark, sf_dir).withColumn("n", F.expr("cast(k % 4 as double)"))
    at = lambda x, y: geo.point(F.expr(x), F.expr(y))
    notched = F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1 - n"), at("x1 - n", "y1 - n"), at("x1 - n", "y1"), at("x0", "y1"))
    rows = s.withColumn("ring", F.when(F.expr("k % 3 = 0"), notched).otherwise(geo.rectangle("x0", "y0", "x1", "y1"))).withColumn("snapped", F.expr("k % 7 = 0"))
    return rows.select("k", F.round(geo.fill_ratio("ring"), 6).alias("ratio"), F.size(legacy.flattened_ring("ring", "snapped")).alias("n_points"))


@query("""with o as (select l_orderkey as path_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as seq, case l_partkey % 3 when 0 then 're' when 1 then 'l' else 'c' end as op from lineitem),
p as (select path_id, string_agg(op, '' order by seq) as ops from o group by path_id), c as (select ops, count(*) as n from p group by ops)
select * from (select ops, n, row_number() over (order by n desc, ops) as pos from c) where pos <= 10""")
def legacy_composition(spark, sf_dir):
    """The ten most frequent sequences of drawing operations."""
    ops = venue.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as path_id", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as seq", "case l_partkey % 3 when 0 then 're' when 1 then 'l' else 'c' end as op")
    top = legacy.composition(ops).orderBy(F.desc("n"), "ops").limit(10)
    return top.selectExpr("*", "row_number() over (order by n desc, ops) as pos")


@query(f"""with {STANDS_SQL}, s as (select venue, "row" // 22 as hall, k as ord, code, x0, y0 from stands),
t as (select *, count(*) filter (where code = 'A08') over (partition by hall) = 2 and count(*) filter (where code = 'A09') over (partition by hall) = 0 and code = 'A08' and row_number() over (partition by hall, code order by y0 desc, ord desc) = 1 as hit from s)
select ord, case when hit then 'A09' else code end as code from t where code in ('A08', 'B04')""")
def legacy_typos(spark, sf_dir):
    """A code that was printed twice becomes the one that lacks, where just two have it."""
    s = venue.stands(spark, sf_dir).selectExpr("row div 22 as hall", "k as ord", "code", "x0", "y0")
    fixed = legacy.fixed_typos(s, [("A08", "A09", "y0"), ("B04", "B06", "x0")], key="hall")
    return fixed.where("code in ('A08', 'A09', 'B04')").select("ord", "code")


@query(f"""with {STANDS_SQL}, w as (select k, x0, x1, lpad((k % 30)::varchar, 2, '0') as a, lpad((k % 30 + 1)::varchar, 2, '0') as b from stands)
select k, 'TI' || a as txt, x0, (x0 + x1) / 2 as x1 from w where k % 2 = 0 union all select k, 'TI' || b, (x0 + x1) / 2, x1 from w where k % 2 = 0 union all select k, 'TI' || a, x0, x1 from w where k % 2 = 1""")
def legacy_split_fused(spark, sf_dir):
    """Fused codes come apart, with half of the box each."""
    txt = "case when k % 2 = 0 then concat('TI', lpad(cast(k % 30 as string), 2, '0'), 'TI', lpad(cast(k % 30 + 1 as string), 2, '0')) else concat('TI', lpad(cast(k % 30 as string), 2, '0')) end as txt"
    return legacy.split_fused(venue.stands(spark, sf_dir).selectExpr("k", txt, "x0", "x1"))


@query(f"""with {STANDS_SQL} select n from range(1, 49) t(n) where n not in (select p_size from stands where p_size % 7 <> 3)""")
def legacy_missing_numbers(spark, sf_dir):
    """The booth numbers that no label has."""
    return legacy.missing_numbers(venue.stands(spark, sf_dir).where("p_size % 7 <> 3").selectExpr("p_size as n"), 48)


#: Blocks of five columns; every fourth row has halves in its second column.
_STRUCTURE = """ce as (select venue, "row", col // 5 as block, col % 5 as cn, 'cheia' as side, (6 + (k % 3) * 0.5)::double as width, code, (min(x0) over (partition by venue, "row", col // 5) + (col // 5) * case when "row" % 2 = 0 then 3 else 12 end)::double as off from stands where not ("row" % 4 = 0 and col % 5 = 1)
  union all select venue, "row", col // 5, col % 5, unnest(['norte', 'sul']), (6 + (k % 3) * 0.5)::double, code || unnest(['N', 'S']), (4 + 34 * (col // 5) + (col // 5) * case when "row" % 2 = 0 then 3 else 12 end)::double from stands where "row" % 4 = 0 and col % 5 = 1)"""


@query(f"""with {STANDS_SQL}, {_STRUCTURE}, st as (select distinct venue, "row", 'RUA ' || ("row" % 100) as name, ("row" % 100) * 14.2 as y from stands),
cl as (select venue, "row", block, cn, max(width) as w, min(off) as off from ce group by all), cx as (select *, off + coalesce(sum(w) over (partition by venue, "row", block order by cn rows between unbounded preceding and 1 preceding), 0) as x from cl),
bl as (select c.venue, c."row", block, min(x) as x0, max(x + w) as x1, any_value(y) as y from cx c join st on st.venue = c.venue and st."row" = c."row" group by 1, 2, 3),
wh as (select venue, min(x0) - 5 as west, max(x1) + 5 as east, min(y) as north, max(y) + 14.2 as south from bl group by venue),
nb as (select *, lead(x0) over (partition by venue, "row" order by block) as nx from bl),
o as (select st.venue, 'rua' as kind, name, west as x0, y as y0, east as x1, y + 4.2 as y1 from st join wh using (venue)
 union all select st.venue, 'rua-eixo', name, min(x0), st.y + 2.1, max(x1), st.y + 2.1 from st join bl on bl.venue = st.venue and bl."row" = st."row" group by st.venue, name, st."row", st.y
 union all select ce.venue, 'estande', code, x, y + 5.5 + case when side = 'sul' then 3.7 else 0 end, x + width, y + 5.5 + case when side = 'norte' then 3.7 else 7.4 end from ce join cx on cx.venue = ce.venue and cx."row" = ce."row" and cx.block = ce.block and cx.cn = ce.cn join st on st.venue = ce.venue and st."row" = ce."row"
 union all select venue, 'quadra', null, x0, y + 5.5, x1, y + 12.9 from bl
 union all select venue, 'rua', null, x1, y + 4.2, nx, y + 14.2 from nb where nx - x1 > 0.5 and nx - x1 <= 12
 union all select venue, 'rua', null, west - 5, north, west, south from wh union all select venue, 'rua', null, east, north, east + 5, south from wh)
select venue, kind, count(*) as n, count(name) as named, round(sum(x0), 4)::double as x0, round(sum(y0), 4)::double as y0, round(sum(x1), 4)::double as x1, round(sum(y1), 4)::double as y1 from o group by venue, kind""")
def legacy_generate(spark, sf_dir):
    """The declarative map's boxes, summed up by kind."""
    s = venue.stands(spark, sf_dir).selectExpr("venue", "row", "col div 5 as block", "cast(col % 5 as int) as column", "cast(6 + (k % 3) * 0.5 as double) as width", "code", "cast(4 + 34 * (col div 5) + (col div 5) * case when row % 2 = 0 then 3 else 12 end as double) as offset")
    half = F.expr("row % 4 = 0 and column = 1")
    cells = s.select("*", F.explode(F.when(half, F.array(F.lit("norte"), F.lit("sul"))).otherwise(F.array(F.lit("cheia")))).alias("side"))
    cells = cells.withColumn("code", F.when(half, F.concat("code", F.upper(F.substring("side", 1, 1)))).otherwise(F.col("code")))
    streets = s.select("venue", "row").distinct().selectExpr("venue", "row", "concat('RUA ', row % 100) as name", "row % 100 as nth")
    out = legacy.generate(cells, streets)
    return out.groupBy("venue", "kind").agg(F.count("*").alias("n"), F.count("name").alias("named"), *[F.round(F.sum(c), 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"""with {STANDS_SQL}, a as (select *, x0 * 2.5 as x, y0 as y, 1.5 + k % 4 as w, 2.0 + k % 3 as h, case when k % 5 = 0 then 'TL' || lpad((k % 60)::varchar, 2, '0') else code end as c from stands),
n as (select *, case when k % 5 = 0 then case when k % 60 between 1 and 48 and k % 60 % 9 <> 4 then 'Autor ' || (k % 60) end when left(code, 1) <> 'D' then 'Empresa ' || substr(code, 2)::int end as entry from a),
o as (select venue, 'area' as kind, p_type as cat, null as code, name, round(w * h * 4, 1) as weight, null as mini, x as x0, y as y0, x + 2 * w as x1, y + 2 * h as y1 from n where col = 3
 union all select venue, 'piso', null, null, null, null, null, min(x) - 4, min(y) - 4, max(x + w) + 4, max(y + h) + 4 from n where x > 255 group by venue
 union all select venue, 'estande', p_type, c, entry, null, w < 2.5 or h < 2.5, x, y, x + w, y + h from n
 union all select venue, 'rua', null, null, 'RUA ' || left(code, 1) || left(code, 1), null, null, 255, y1, 300, y1 + 4 from n where col = 0
 union all select venue, 'rua-eixo', null, null, 'RUA ' || left(code, 1) || left(code, 1), null, null, 255, y1 + 2, 300, y1 + 2 from n where col = 0
 union all select venue, 'poi', 'entrada', null, 'Entrada ' || "row", null, null, x, y, x, y from n where col = 7)
select venue, kind, count(*) as n, count(cat) as cats, count(code) as codes, count(name) as named, min(name) as first_name, max(name) as last_name, count(*) filter (where mini) as minis, round(coalesce(sum(weight), 0), 3)::double as weight,
  round(sum(x0), 4)::double as x0, round(sum(y0), 4)::double as y0, round(sum(x1), 4)::double as x1, round(sum(y1), 4)::double as y1 from o group by venue, kind""")
def legacy_generate_annex(spark, sf_dir):
    """The declarative map's boxes by position: areas, stands with names from the directory, the annex's floor and streets, places."""
    s = venue.stands(spark, sf_dir).selectExpr("*", "x0 * 2.5D as x", "y0 as y", "1.5D + k % 4 as w", "2D + k % 3 as h")
    areas = s.where("col = 3").selectExpr("venue", "p_type as cat", "cast(null as string) as code", "name", "x", "y", "2 * w as w", "2 * h as h")
    stands = s.selectExpr("venue", "p_type as cat", "case when k % 5 = 0 then concat('TL', lpad(cast(k % 60 as string), 2, '0')) else code end as code", "x", "y", "w", "h")
    streets = s.where("col = 0").selectExpr("venue", "concat('RUA ', substring(code, 1, 1), substring(code, 1, 1)) as name", "255D as x", "y1 as y", "45D as w", "4D as h")
    places = s.where("col = 7").selectExpr("venue", "'entrada' as cat", "concat('Entrada ', row) as name", "x", "y")
    exhibitors = s.where("code not like 'D%'").selectExpr("code", "concat('EMPRESA ', cast(substring(code, 2) as int)) as name").distinct()
    booths = spark.range(1, 49).where("id % 9 <> 4").selectExpr("id as n", "concat('AUTOR ', id) as name")
    out = legacy.generate_anchored(areas, stands, streets, places, exhibitors, booths)
    return out.groupBy("venue", "kind").agg(
        F.count("*").alias("n"), F.count("cat").alias("cats"), F.count("code").alias("codes"), F.count("name").alias("named"), F.min("name").alias("first_name"), F.max("name").alias("last_name"),
        F.count_if("mini").alias("minis"), F.round(F.coalesce(F.sum("weight"), F.lit(0.0)), 3).alias("weight"), *[F.round(F.sum(c), 4).alias(c) for c in ("x0", "y0", "x1", "y1")],
    )


@query(f"""with {STANDS_SQL}, s as (select venue, k as ord, code, "row" as band, col, x0 * 3 as x0, x1 * 3 - 1 as x1 from stands where k % 17 <> 3), g as (select *, x0 - max(x1) over (partition by venue, band order by x0, ord rows between unbounded preceding and 1 preceding) as gap from s),
b as (select *, sum(case when gap > 8 then 1 else 0 end) over (partition by venue, band order by x0, ord) as block from g)
select venue, ord, code, band, block::int as block, (row_number() over (partition by venue, band, block order by x0, ord) - 1)::int as "column", 'cheia' as side, x1 - x0 as width, min(x0) over (partition by venue, band, block) as "offset" from b
union all select venue, k, code, null, null, null, null, null, null from stands where k % 17 = 3""")
def legacy_import_structure(spark, sf_dir):
    """Drawn cells as rows, blocks and columns; cells in no band stay without a place."""
    s = venue.stands(spark, sf_dir)
    bands = s.groupBy("venue", F.col("row").alias("band")).agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"))
    cells = s.selectExpr("venue", "k as ord", "code", "x0 * 3 as x0", "y0 + case when k % 17 = 3 then 5000D else 0D end as y0", "x1 * 3 - 1 as x1", "y1 + case when k % 17 = 3 then 5000D else 0D end as y1")
    return legacy.import_structure(cells, bands)
