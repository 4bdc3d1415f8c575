"""Queries on labels and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium import params
from atrium.functions import geometry as geo
from atrium.operators import labels as lab
from atrium.operators.classify import in_box, wholly_in
from atrium.sources import venue
from atrium.sources.venue import DOORS_SQL, STANDS_SQL, VENUES_SQL

from .registry import query


def shapes(spark, sf_dir):
    return venue.stands(spark, sf_dir).withColumn("ring", geo.rectangle("x0", "y0", "x1", "y1"))


def code_labels(spark, sf_dir):
    """A code in the middle of each stand; every seventeenth is broken into head and tail."""
    rows = venue.stands(spark, sf_dir).selectExpr("venue", "k * 2 as label_id", "code as txt", "x0 + 3 as x", "y0 + 3 as y", "1.0D as size", "k")
    broken = rows.where("k % 17 = 0")
    head = broken.selectExpr("venue", "label_id", "substring(txt, 1, 2) as txt", "x", "y", "size")
    tail = broken.selectExpr("venue", "label_id + 1 as label_id", "substring(txt, 3) as txt", "x + 0.2D as x", "y + 0.9D as y", "size")
    return rows.where("k % 17 <> 0").drop("k").union(head).union(tail)


@query(f"""with {STANDS_SQL} select venue, k as ord, k * 2 as label_id, code as txt from stands""")
def code_containment(spark, sf_dir):
    """Repaired codes, each claimed by the first shape that holds it."""
    whole = lab.repair_codes(code_labels(spark, sf_dir)).drop("joined")
    return lab.claim_codes(shapes(spark, sf_dir), whole)


@query(f"""with {STANDS_SQL} select venue, k * 2 as label_id, code as txt, k % 17 = 0 as joined from stands""")
def code_repair(spark, sf_dir):
    return lab.repair_codes(code_labels(spark, sf_dir)).select("venue", "label_id", "txt", "joined")


@query(f"""with {STANDS_SQL}, l as (select k, "row", y1 + 2 as y, x0 + 3 as x, case when k % 3 = 0 then 'RUA ' || left(code, 1) else name end as t, venue from stands where col < 3)
select venue, k as ord, name || ' ' || code as name from stands""")
def names_inside_shapes(spark, sf_dir):
    """Texts inside each shape, ordered from the top, joined by a space."""
    s = venue.stands(spark, sf_dir)
    labels = s.selectExpr("venue", "k * 2 as label_id", "name as txt", "x0 + 2 as x", "y0 + 2 as y").union(s.selectExpr("venue", "k * 2 + 1", "code", "x0 + 1", "y0 + 4"))
    return lab.names_inside(shapes(spark, sf_dir), labels, by=("y", "x"))


@query(f"""with {STANDS_SQL}, {VENUES_SQL}, p as (select s_suppkey as ord, s_suppkey % nv as venue, 2.0::double as px, (4 + 10 * (s_suppkey // nv % 100) + 8 + (s_suppkey % 3) * 0.25)::double as py from supplier, nv),
l as (select venue, k as label_id, name as txt, x0 - 1 as x, y1 + 1.5 as y from stands),
m as (select ord, px, py, txt, sqrt((x - px) * (x - px) + (y - py) * (y - py)) as d, label_id from p join l on l.venue = p.venue),
b as (select ord, txt, d, row_number() over (partition by ord order by d, label_id) as n from m where d < 8)
select p.ord, txt as name, round(d, 6) as distance from p left join b on b.ord = p.ord and n = 1""")
def poi_nearest_label(spark, sf_dir):
    """The nearest label within 8 m of each door, in all venues."""
    n = venue.venues(spark, sf_dir)
    points = venue.table(spark, sf_dir, "supplier").selectExpr(f"s_suppkey % {n}L as venue", "s_suppkey as ord", "2D as px", f"4 + 10 * (s_suppkey div {n}L % 100) + 8 + (s_suppkey % 3) * 0.25D as py")
    labels = venue.stands(spark, sf_dir).selectExpr("venue", "k as label_id", "name as txt", "x0 - 1 as x", "y1 + 1.5D as y")
    return lab.nearest_label(points, labels).select("ord", "name", F.round("distance", 6).alias("distance"))


@query(f"""with {STANDS_SQL} select venue, k, printf('TL%02d', row_number() over (partition by venue order by round_even((y0 + 3) / 2, 0), x0 + 3, k)) as booth from stands""")
def booth_numbering(spark, sf_dir):
    rows = venue.stands(spark, sf_dir).selectExpr("venue", "k", "ord", "x0 + 3 as cx", "y0 + 3 as cy")
    return lab.number_booths(rows).select("venue", "k", "booth")


_BLOCKS = """b as (select k, k // 5 as block, x0 + 1 + (k * 7 % 5)::double * 0.5 + (k % 5) * 0.1 as x, case when k % 5 < 3 then y0 + 1 else y0 + 4 end as y, min(x0) over w as x0, min(y0) over w as y0, max(x1) over w as x1, max(y1) over w as y1 from stands window w as (partition by k // 5)),
l as (select *, case when y > y0 + 2 then 1 else 0 end as line from b),
h as (select block, line, avg(y) as h, any_value(y0) as b0, any_value(y1) as b1 from l group by block, line)"""


@query(f"""with {STANDS_SQL}, {_BLOCKS},
r as (select block, line, coalesce((lag(h) over u + h) / 2, b0) as ya, coalesce((lead(h) over u + h) / 2, b1) as yb from h window u as (partition by block order by line)),
c as (select k, block, line, coalesce((lag(x) over v + x) / 2, x0) as xa, coalesce((lead(x) over v + x) / 2, x1) as xb from l window v as (partition by block, line order by x, k))
select k, c.line, round(xa, 6) as xa, round(ya, 6) as ya, round(xb, 6) as xb, round(yb, 6) as yb from c join r on r.block = c.block and r.line = c.line""")
def block_split_midpoints(spark, sf_dir):
    """A block with several codes, cut midway between them: rows first, then columns."""
    s = venue.stands(spark, sf_dir)
    box = s.groupBy(F.expr("k div 5").alias("block")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    pts = s.selectExpr("k as label_id", "k div 5 as block", "x0 + 1 + cast(k * 7 % 5 as double) * 0.5D + (k % 5) * 0.1D as x", "case when k % 5 < 3 then y0 + 1 else y0 + 4 end as y").join(box, "block")
    rows = lab.cut_at_midpoints(lab.label_rows(pts, "block", "2"), "block")
    return rows.select(F.col("label_id").alias("k"), "line", *[F.round(c, 6).alias(c) for c in ("xa", "ya", "xb", "yb")])


@query(f"""with recursive {STANDS_SQL}, o as (select k, k // 5 as block, y0 + (k % 5) * 1.5 as y, row_number() over (partition by k // 5 order by y0 + (k % 5) * 1.5, k) as n from stands),
r as (select block, n, k, y as first, 0 as line from o where n = 1 union all select o.block, o.n, o.k, case when o.y - r.first > 2 then o.y else r.first end, r.line + (o.y - r.first > 2)::int from r join o on o.block = r.block and o.n = r.n + 1)
select k, line from r""")
def label_rows(spark, sf_dir):
    """Rows of labels that drift: a new one starts where the height is too far from the row's first."""
    s = venue.stands(spark, sf_dir).selectExpr("k as label_id", "k div 5 as block", "y0 + (k % 5) * 1.5D as y")
    return lab.label_rows(s, "block", "2").select(F.col("label_id").alias("k"), "line")


@query(f"""with {STANDS_SQL}, l as (select k // 4 as line, k, code, name, 0.5 + (k % 3) * 0.5 as size, x0, y0, x1, y1 from stands)
select line, string_agg(case when k % 2 = 0 then code else name end, ' ' order by k) as txt, max(size)::double as size, bool_or(size > 0.9 and k % 2 = 1) as named, bool_and(x0 >= 0 and x1 <= 90 and y0 >= 0 and y1 <= 400) as in_legend, bool_or((x0 + x1) / 2 between 20 and 61 and (y0 + y1) / 2 between 0 and 300) as in_lane from l group by line""")
def label_filters(spark, sf_dir):
    """Spans to lines with their largest size, the size filter, the legend box (all vertices) and the lane box (a centre)."""
    rows = venue.stands(spark, sf_dir).selectExpr("k div 4 as line", "k", "case when k % 2 = 0 then code else name end as txt", "cast(0.5 + (k % 3) * 0.5 as double) as size", "x0", "y0", "x1", "y1").withColumn("ring", geo.rectangle("x0", "y0", "x1", "y1"))
    named = (F.col("size") > params.LABEL_MIN_SIZE) & ~F.col("txt").rlike(params.CODE_RE)
    lines = rows.groupBy("line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "txt"))), lambda r: r["txt"]), " ").alias("txt"), F.max("size").alias("size"), F.bool_or(named).alias("named"), F.bool_and(wholly_in("ring", (0.0, 0.0, 90.0, 400.0))).alias("in_legend"), F.bool_or(in_box("ring", (20.0, 0.0, 61.0, 300.0))).alias("in_lane"))
    return lines.select("line", "txt", "size", "named", "in_legend", "in_lane")


@query(f"""with {STANDS_SQL}, {DOORS_SQL}, t as (select door, case door % 3 when 0 then 'Entrada Pública' when 1 then 'ACESSO SERVIÇO HALL' else 'acesso servico' end || ' ' || door as name, [{{i: (door % 7)::int, j: 1}}, {{i: (door % 5)::int, j: 2}}] as cells from doors),
u as (select door, name, unnest(cells) as c from t)
select door, name, not (contains(lower(name), 'serviço') or contains(lower(name), 'servico')) as is_public, c.i as i, c.j as j from u""")
def door_split(spark, sf_dir):
    """Public and service doors by name, one row for each of a door's cells."""
    rows = venue.doors(spark, sf_dir).selectExpr("door", "concat(case door % 3 when 0 then 'Entrada Pública' when 1 then 'ACESSO SERVIÇO HALL' else 'acesso servico' end, ' ', door) as name", "array(struct(cast(door % 7 as int) as i, 1 as j), struct(cast(door % 5 as int) as i, 2 as j)) as cells")
    service = F.lower("name").contains("serviço") | F.lower("name").contains("servico")
    return rows.select("door", "name", (~service).alias("is_public"), F.explode("cells").alias("c")).select("door", "name", "is_public", "c.i", "c.j")


#: Four spans a line, some blank; the window cuts the page's right side off.
_SPANS = "case when k % 11 = 0 then '  ' when k % 3 = 0 then ' ' || code || ' ' else name end"
_SPAN_SQL = f"""spans as (select venue as page, "row" as block, col // 4 as line, (col % 4)::int as pos, {_SPANS} as text, 4.0 + k % 5 as size, x0, y0, x1, y0 + 4 as y1 from stands),
seen as (select * from spans where least(x1, 118.0) > greatest(x0, 10.0) and least(y1, 900.0) > greatest(y0, 30.0))"""


@query(f"""with {STANDS_SQL}, {_SPAN_SQL},
l as (select page, block, line, trim(string_agg(text, ' ' order by pos)) as txt, (min(x0) + max(x1)) / 2 as x, (min(y0) + max(y1)) / 2 as y, max(size) as size from seen group by page, block, line)
select page, block, line, pos, trim(text) as txt, round(((x0 + x1) / 2 - 10) * {params.M_PER_POINT}, 3)::double as x, round(((y0 + y1) / 2 - 30) * {params.M_PER_POINT}, 3)::double as y, round(size * {params.M_PER_POINT}, 6)::double as size from seen where trim(text) <> ''
union all select page, block, line, null, txt, round((x - 10) * {params.M_PER_POINT}, 3)::double, round((y - 30) * {params.M_PER_POINT}, 3)::double, round(size * {params.M_PER_POINT}, 6)::double from l where txt <> ''""")
def text_scan(spark, sf_dir):
    """The text of a page as labels, span by span and line by line."""
    from atrium.operators.drawing import text_labels

    text = F.expr("case when k % 11 = 0 then '  ' when k % 3 = 0 then concat(' ', code, ' ') else name end").alias("text")
    spans = venue.stands(spark, sf_dir).select(F.col("venue").alias("page"), F.col("row").alias("block"), F.expr("col div 4 as line"), F.expr("cast(col % 4 as int) as pos"), text, F.expr("4D + k % 5 as size"), "x0", "y0", "x1", F.expr("y0 + 4 as y1"))
    both = [text_labels(spans, (10.0, 30.0, 118.0, 900.0), by_line=line) for line in (False, True)]
    return both[0].unionByName(both[1]).withColumn("size", F.round("size", 6))
