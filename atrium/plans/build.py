"""The map's build: a drawing to one table of features of all kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium import params
from atrium.functions import geometry as geo
from atrium.functions.text import title_case
from atrium.operators import corridors
from atrium.operators import labels as lab
from atrium.operators.classify import classify, in_box, wholly_in
from atrium.operators.grid import stored
from atrium.sources import venue
from atrium.sources.venue import STANDS_SQL

from . import corridors as ways
from .features import FEATURES_SQL
from .registry import query

#: The fixture's legend and lane of booths.
LEGEND, LANE = (100.0, 0.0, 140.0, 12.0), (0.0, 0.0, 2.0, 100000.0)
_TITLE = "array_to_string([case when i > 1 and ws[i] in ('de', 'da', 'do', 'das', 'dos', 'e', 'em', 'a', 'o') then ws[i] else upper(ws[i][1:1]) || ws[i][2:] end for i in range(1, len(ws) + 1)], ' ')"


def drawing(spark, sf_dir):
    """(shapes, labels) of a drawing: stands, a street arrow a row, booths inside and outside the lane, triangles of
    doors, and floors; with codes, names and door labels, and some that aren't what they look like."""
    s = venue.stands(spark, sf_dir)
    row = s.where("col = 0")
    colour = lambda r, g, b: f"{r} as r, {g} as g, {b} as b"
    shape = lambda df, ord_, ring, rgb: df.withColumn("ring", ring).selectExpr("venue", f"k * 10 + {ord_} as ord", "ring", *rgb.split(", "))
    at = lambda x, y: geo.point(F.expr(x), F.expr(y))
    box = lambda x0, y0, x1, y1: F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1))
    shapes = [
        shape(s, 0, box("x0", "y0", "x1", "y1"), "cast(r as int) as r, cast(g as int) as g, cast(b as int) as b"),
        shape(row, 1, box("60D", "y1 + 1", "66D", "y1 + 2"), colour(*params.STREET)),
        shape(row.where("row % 10 = 0"), 2, box("137D", "y0", "139D", "y1"), colour(128, 129, 129)),
        shape(row.where("row % 5 = 0"), 3, F.array(at("1D", "y1 + 1"), at("3D", "y1 + 1"), at("2D", "y1 + 3")), colour(9, 146, 71)),
        shape(row.where("row % 4 = 1"), 4, box("0.2D", "y0", "1.2D", "y0 + 1.5"), colour(255, 255, 255)),
        shape(row.where("row % 4 = 2"), 5, box("138D", "y0", "139D", "y0 + 1.5"), colour(255, 255, 255)),
    ]
    label = lambda df, n, txt, x, y, size=1.0: df.selectExpr("venue", f"k * 10 + {n} as label_id", f"{txt} as txt", f"{x} as x", f"{y} as y", f"cast({size} as double) as size")
    labels = [
        label(s.where("k % 7 <> 0"), 0, "code", "x0 + 3", "y0 + 3"), label(s.where("k % 2 = 0"), 1, "concat('PRAÇA ', name)", "x0 + 2", "y0 + 2"), label(s.where("k % 2 = 1"), 2, "'too small'", "x0 + 2", "y0 + 2", 0.7),
        label(row, 3, "case when row % 3 <> 0 then concat('Rua ', substring(code, 1, 1)) else 'VIELA' end", "63D", "y1 + 1.5"),
        label(row.where("row % 5 = 0 and row % 15 <> 0"), 4, "concat('ENTRADA ', row)", "2D", "y1 + 4"), label(row.where("row % 5 = 0"), 5, "'BANHEIRO'", "2D", "y1 + 2.5"),
    ]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(shapes), union(labels)


def directories(spark, sf_dir):
    """(code, name) of exhibitors and (n, name) of booths."""
    exhibitors = venue.stands(spark, sf_dir).where("col % 3 <> 0").selectExpr("code", "concat('EMPRESA DE ', code) as name").distinct()
    return exhibitors, spark.range(1, 49).where("id % 5 <> 0").selectExpr("cast(id as int) as n", "concat('AUTOR ', id) as name")


def map_features_of(spark, sf_dir):
    """All features of the drawing but ways and circulation, one union of the kinds' streams."""
    shapes, labels = drawing(spark, sf_dir)
    exhibitors, authors = directories(spark, sf_dir)
    box = geo.ring_bbox("ring")
    s = shapes.withColumns({"area": F.abs(geo.ring_area("ring")), "n_vertices": F.size("ring"), **{c: box[c] for c in ("x0", "y0", "x1", "y1")}, "in_lane": in_box("ring", LANE)})
    s = stored(s, "drawing")  # else the rules below repeat these expressions wherever they ask for a column
    s = classify(s.where(F.col("area") >= params.MIN_SHAPE_AREA).where(~wholly_in("ring", LEGEND))).where("kind is not null").withColumn("area_m2", F.round("area", 1))
    s, labels = stored(s, "shapes"), stored(labels, "labels")  # every stream reads them
    own = ["venue", "ord", "kind", "cat", "area_m2", "ring"]
    arrows = s.where("kind = 'rua'")
    streets = arrows.join(lab.names_inside(arrows, labels), ["venue", "ord"], "left").select(*own, lab.street_name("name").alias("name"))
    centre = geo.bbox_centre("ring")
    pois = s.where("kind = 'poi'").withColumns({"px": centre["x"], "py": centre["y"]})
    named = lab.nearest_label(pois.select("venue", "ord", "px", "py"), lab.door_labels(labels.where(~F.col("txt").rlike(params.CODE_RE)))).select("venue", "ord", "name")
    doors = pois.join(named, ["venue", "ord"], "left").select("venue", "ord", "kind", "cat", "ring", title_case("name").alias("name"))
    booths = lab.number_booths(s.where("cat = 'travessa'").withColumns({"cx": centre["x"], "cy": centre["y"]})).withColumn("n", F.substring("booth", 3, 9).cast("int"))
    booths = lab.with_directory(booths, authors, "n").select(*own, F.col("booth").alias("code"), "name", F.lit(True).alias("mini"), F.lit(True).alias("numbered"))
    solid = s.where("kind in ('estande', 'area', 'piso') and cat is distinct from 'travessa'")
    codes = lab.claim_codes(solid, labels.where(F.col("txt").rlike(params.CODE_RE))).groupBy("venue", "ord").agg(F.min_by("txt", "label_id").alias("code"))
    solid = solid.join(codes, ["venue", "ord"], "left")
    stands = lab.with_directory(solid.where("kind = 'estande' and code is not null"), exhibitors).select(*own, "code", "name", F.when(F.col("area") < params.MINI_AREA, True).alias("mini"))
    others = solid.where("not (kind = 'estande' and code is not null)")
    text = lab.names_inside(others, labels.where((F.col("size") > params.LABEL_MIN_SIZE) & ~F.col("txt").rlike(params.CODE_RE)), by=("y", "x"))
    others = others.join(text, ["venue", "ord"], "left").withColumn("name", title_case("name"))
    derived = F.col("name").isNull() & F.coalesce(F.col("cat") == "alimentacao", F.lit(False))
    others = others.select(*own, "code", F.when(derived, params.FOOD_COURT).otherwise(F.col("name")).alias("name"), F.when(derived, True).alias("derived"))
    out = stands
    for more in (booths, others, doors, streets):
        out = out.unionByName(more, allowMissingColumns=True)
    return out


_MAP = f"""{FEATURES_SQL},
dr as (select distinct code, 'Empresa de ' || code as name from stands where col % 3 <> 0),
so as (select f.venue, f.k * 10 as ord, f.kind, f.cat, case when f.k % 7 <> 0 then f.code end as code, f.k, [x for x in regexp_split_to_array(trim(lower('PRAÇA ' || f.name)), '\\s+') if x <> ''] as ws from features f where not (f.x0 >= 100 and f.x1 <= 140 and f.y0 >= 0 and f.y1 <= 12)),
st as (select so.venue, so.ord, so.kind, so.cat, 36.0::double as area_m2, so.code, dr.name, null::boolean as mini, null::boolean as numbered, null::boolean as derived from so left join dr on dr.code = so.code where so.kind = 'estande' and so.code is not null),
ot as (select venue, ord, kind, cat, 36.0::double as area_m2, code, case when k % 2 = 0 then {_TITLE} when cat = 'alimentacao' then 'Praça de Alimentação' end as name, null::boolean as mini, null::boolean as numbered, case when k % 2 <> 0 and cat = 'alimentacao' then true end as derived from so where not (kind = 'estande' and code is not null)),
rw as (select venue, "row", k, left(code, 1) as letter from stands where col = 0),
mf as (select * from st union all select * from ot
 union all select venue, k * 10 + 1, 'rua', null, 6.0, null, case when "row" % 3 <> 0 then 'RUA ' || letter end, null, null, null from rw
 union all select venue, k * 10 + 2, 'piso', null, 12.0, null, null, null, null, null from rw where "row" % 10 = 0 and "row" % 100 <> 0
 union all select venue, k * 10 + 3, 'poi', 'entrada', null, null, case when "row" % 15 <> 0 then 'Entrada ' || "row" end, null, null, null from rw where "row" % 5 = 0
 union all select venue, ord, 'estande', 'travessa', 1.5, printf('TL%02d', n), case when n <= 48 and n % 5 <> 0 then 'Autor ' || n end, true, true, null from (select venue, k * 10 + 4 as ord, row_number() over (partition by venue order by k) as n from rw where "row" % 4 = 1))"""


@query(f"with {_MAP} select venue, ord, kind, cat, area_m2, code, name, mini, numbered, derived from mf")
def map_features(spark, sf_dir):
    """One table of stands, booths, areas, floors, doors and street arrows with codes and names."""
    return map_features_of(spark, sf_dir).select("venue", "ord", "kind", "cat", "area_m2", "code", "name", "mini", "numbered", "derived")


@query(f"""with {_MAP}, n as (select venue, k, code, row_number() over (partition by venue order by round_even((y0 + 3) / 2, 0), x0 + 3, k) as n from stands)
select n.venue, n.k, n.code, dr.name, printf('TL%02d', n) as booth, case when n <= 48 and n % 5 <> 0 then 'Autor ' || n end as author from n left join dr on dr.code = n.code""")
def stand_directory(spark, sf_dir):
    """Names of stands by code and of booths by number, from the directory."""
    exhibitors, authors = directories(spark, sf_dir)
    rows = lab.number_booths(venue.stands(spark, sf_dir).selectExpr("venue", "k", "ord", "code", "x0 + 3 as cx", "y0 + 3 as cy")).withColumn("n", F.substring("booth", 3, 9).cast("int"))
    named = lab.with_directory(rows, authors, "n").withColumnRenamed("name", "author")
    return lab.with_directory(named, exhibitors).select("venue", "k", "code", "name", "booth", "author")


@query(f"""with {_MAP}, {ways._CORRIDOR.removeprefix(STANDS_SQL + ", ")}, {ways._RUNS}, {ways._TRACKS}, {ways._NAMED}
select venue, kind, cat, count(*) as n, count(name) as named, round(sum(area_m2), 3)::double as area_m2 from mf group by venue, kind, cat union all select venue, 'via', axis, count(*), count(name), sum(extent)::double from merged group by venue, axis
union all select venue, 'circulacao', null, 1, 0, count(*)::double from corr where corridor group by venue""")
def map_kinds(spark, sf_dir):
    """The whole map, counted by kind: features, named ways (their metres) and circulation (its square metres)."""
    named, _, corridor = ways.named_ways(spark, sf_dir)
    per = lambda rows: rows.groupBy("venue", "kind", "cat").agg(F.count("*").alias("n"), F.count("name").alias("named"), F.round(F.sum("area_m2"), 3).alias("area_m2"))
    # Counts of each part are written by themselves: one plan of them all is long work for the driver and its memory.
    features = stored(per(map_features_of(spark, sf_dir).select("venue", "kind", "cat", "name", "area_m2")), "kinds")
    merged = corridors.merge_ways(named).select("venue", F.lit("via").alias("kind"), F.col("axis").alias("cat"), "name", F.col("extent").cast("double").alias("area_m2"))
    open_ = corridor.groupBy("venue").agg(F.count("*").cast("double").alias("area_m2")).selectExpr("venue", "'circulacao' as kind", "cast(null as string) as cat", "1L as n", "0L as named", "area_m2")
    return features.unionByName(stored(per(merged), "kinds")).unionByName(open_)
