"""Queries on shapes and features: geometry, classification, counts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium import params
from atrium.functions import geometry as geo
from atrium.operators.classify import classify, fix_prisms, rgb_ints
from atrium.sources import venue
from atrium.sources.venue import STANDS_SQL

from .registry import query

#: The stands as classified features, in DuckDB.
FEATURES_SQL = f"""{STANDS_SQL},
features as (select *, 36.0::double as area_m2,
  case when abs(r - 237) <= 18 and abs(g - 33) <= 18 and abs(b - 36) <= 18 or abs(r - 192) <= 18 and abs(g - 226) <= 18 and abs(b - 202) <= 18 and not (abs(r - 187) <= 18 and abs(g - 230) <= 18 and abs(b - 251) <= 18)
    or abs(r - 250) <= 18 and abs(g - 163) <= 18 and abs(b - 26) <= 18 then 'area' else 'estande' end as kind,
  case p_type when 'STANDARD' then 'expositor' when 'ECONOMY' then 'cultural' when 'MEDIUM' then 'patrocinador' when 'PROMO' then 'entidade' when 'SMALL' then 'infra' else 'alimentacao' end as cat
  from stands)"""


def features(spark, sf_dir):
    """The stands with ring, area, kind and cat."""
    rows = venue.stands(spark, sf_dir).withColumn("ring", geo.rectangle("x0", "y0", "x1", "y1"))
    # By a generator, so that no rule or filter on the area has it worked out again.
    rows = rows.select("*", F.explode(F.array(F.abs(geo.ring_area("ring")))).alias("area")).withColumns({"n_vertices": F.size("ring"), "in_lane": F.lit(False)})
    return classify(rows).withColumn("area_m2", F.round("area", 1))


@query(f"""with {FEATURES_SQL}
select kind, cat, count(*) as n, sum(area_m2) as total_m2, avg(area_m2) as mean_m2 from features group by kind, cat""")
def stand_area_by_category(spark, sf_dir):
    return features(spark, sf_dir).groupBy("kind", "cat").agg(F.count("*").alias("n"), F.sum("area_m2").alias("total_m2"), F.avg("area_m2").alias("mean_m2"))


@query(f"""with {FEATURES_SQL}
select coalesce(cat, kind) as key, count(*) as n, count(code) as with_code, count(nullif(name, '')) as with_name from features group by grouping sets ((coalesce(cat, kind)), ())""")
def feature_counts_grouping(spark, sf_dir):
    """Counts by category plus one row over all (null key)."""
    rows = features(spark, sf_dir).withColumn("key", F.coalesce("cat", "kind"))
    return rows.rollup("key").agg(F.count("*").alias("n"), F.count("code").alias("with_code"), F.count(F.nullif("name", F.lit(""))).alias("with_name"))


@query(f"""with {FEATURES_SQL}
select venue, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from features where kind is not null group by venue""")
def drawing_bbox(spark, sf_dir):
    rows = features(spark, sf_dir).where("kind is not null").withColumn("box", geo.ring_bbox("ring"))
    return rows.groupBy("venue").agg(F.min("box.x0").alias("x0"), F.min("box.y0").alias("y0"), F.max("box.x1").alias("x1"), F.max("box.y1").alias("y1"))


_SHAPES = """shapes as (select k, r, g, b, (k % 7)::double * 0.75 + 0.5 as w, (k % 5)::double + 0.6 as h, 3 + (k % 3) as n_vertices, k % 4 = 0 as in_lane, k % 6 as pick from stands),
coloured as (select k, w, h, w * h as area, n_vertices, in_lane,
  case pick when 0 then r when 1 then 198 when 2 then 237 when 3 then 255 when 4 then 128 else 9 end as r,
  case pick when 0 then g when 1 then 177 when 2 then 33 when 3 then 255 when 4 then 129 else 146 end as g,
  case pick when 0 then b when 1 then 152 when 2 then 36 when 3 then 255 when 4 then 129 else 71 end as b from shapes),
snapped as (select *, case when abs(r - 187) <= 18 and abs(g - 230) <= 18 and abs(b - 251) <= 18 then 1 when abs(r - 237) <= 18 and abs(g - 33) <= 18 and abs(b - 36) <= 18 then 2
  when abs(r - 250) <= 18 and abs(g - 238) <= 18 and abs(b - 19) <= 18 then 3 when abs(r - 179) <= 18 and abs(g - 127) <= 18 and abs(b - 184) <= 18 then 4
  when abs(r - 192) <= 18 and abs(g - 226) <= 18 and abs(b - 202) <= 18 then 5 when abs(r - 250) <= 18 and abs(g - 163) <= 18 and abs(b - 26) <= 18 then 6 end as p from coloured)"""


@query(f"""with {STANDS_SQL}, {_SHAPES},
poi as (select *, case when r = 9 and g = 146 and b = 71 then 'entrada' when r = 237 and g = 33 and b = 36 then 'saida' end as access from snapped),
c as (select k,
  case when r = 198 and g = 177 and b = 152 then 'rua' when access is not null and area < 4 and n_vertices <= 4 then 'poi' when r = 255 and g = 255 and b = 255 and area < 3 and in_lane then 'estande'
    when p is not null and area >= 1 then case when least(w, h) < 1.8 and greatest(w, h) > 2.5 * least(w, h) or p in (2, 5, 6) and area < 5 then null when p in (2, 5, 6) then 'area' else 'estande' end
    when r = 128 and g = 129 and b = 129 and area >= 1 then 'piso' end as kind,
  case when r = 198 and g = 177 and b = 152 then null when access is not null and area < 4 and n_vertices <= 4 then access when r = 255 and g = 255 and b = 255 and area < 3 and in_lane then 'travessa'
    when p is not null and area >= 1 then case when least(w, h) < 1.8 and greatest(w, h) > 2.5 * least(w, h) or p in (2, 5, 6) and area < 5 then null
      else ['expositor', 'cultural', 'patrocinador', 'entidade', 'infra', 'alimentacao'][p] end end as cat from poi)
select kind, cat, count(*) as n, min(k) as first_k, max(k) as last_k from c group by kind, cat""")
def classify_priority(spark, sf_dir):
    """The priority of the classification rules, on shapes that meet several of them."""
    pick = F.col("k") % 6
    rows = venue.stands(spark, sf_dir).selectExpr("k", "r", "g", "b", "cast(k % 7 as double) * 0.75D + 0.5D as w", "cast(k % 5 as double) + 0.6D as h", "3 + (k % 3) as n_vertices", "k % 4 = 0 as in_lane")
    of = lambda own, *others: F.coalesce(*[F.when(pick == i + 1, v) for i, v in enumerate(others)], own)
    rows = rows.withColumns({"r": of(F.col("r"), 198, 237, 255, 128, 9), "g": of(F.col("g"), 177, 33, 255, 129, 146), "b": of(F.col("b"), 152, 36, 255, 129, 71), "area": F.expr("w * h"), "x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.col("w"), "y1": F.col("h")})
    return classify(rows).groupBy("kind", "cat").agg(F.count("*").alias("n"), F.min("k").alias("first_k"), F.max("k").alias("last_k"))


@query(f"""with {STANDS_SQL},
f as (select venue, k * 3 as ord, x0 - 1.4 as x0, y0 - 1.4 as y0, x1 - 1.4 as x1, y1 - 1.4 as y1 from stands where p_size % 10 = 0
  union all select venue, k * 3, x0, y0, x1, y1 from stands where p_size % 10 <> 0
  union all select venue, k * 3 + 1, x0 - 1.4, y1 - 1.4, x1, y1 from stands where p_size % 10 = 0
  union all select venue, k * 3 + 2, x1 - 1.4, y0 - 1.4, x1, y1 from stands where p_size % 10 = 0)
select venue, k * 3 as ord, x0, y0, x1, y1, p_size % 10 = 0 as moved from stands""")
def prism_fix(spark, sf_dir):
    """Blocks drawn as prisms come back as the rectangles they stand on."""
    s = venue.stands(spark, sf_dir)
    tall = s.where("p_size % 10 = 0")
    shapes = s.where("p_size % 10 <> 0").selectExpr("venue", "k * 3 as ord", "x0", "y0", "x1", "y1")
    for shift, x0, y0, x1, y1 in ((0, "x0 - 1.4D", "y0 - 1.4D", "x1 - 1.4D", "y1 - 1.4D"), (1, "x0 - 1.4D", "y1 - 1.4D", "x1", "y1"), (2, "x1 - 1.4D", "y0 - 1.4D", "x1", "y1")):
        shapes = shapes.union(tall.selectExpr("venue", f"k * 3 + {shift}", x0, y0, x1, y1))
    out = fix_prisms(shapes)
    return out.select("venue", "ord", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")], "moved")


@query(f"""with {STANDS_SQL} select k, 36.0::double as area, 1 as n_holes, x0 + 3 as mean_x, y0 + 3 as mean_y, x0 + 3 as centroid_x, y0 + 3 as centroid_y from stands""")
def ring_exterior_holes(spark, sf_dir):
    """Exterior, holes and the two kinds of centre of shapes with an inner ring and a sliver."""
    s = venue.stands(spark, sf_dir)
    inner = geo.rectangle(F.col("x0") + 1, F.col("y0") + 1, F.col("x0") + 3, F.col("y0") + 3)
    sliver = geo.rectangle("x0", "y0", F.col("x0") + 0.5, F.col("y0") + 1)
    rows = s.withColumn("rings", F.array(inner, geo.rectangle("x0", "y0", "x1", "y1"), sliver))
    rows = rows.withColumn("ext", geo.exterior("rings")).withColumns({"mean": geo.vertex_mean("ext"), "centroid": geo.ring_centroid("ext")})
    return rows.select("k", F.abs(geo.ring_area("ext")).alias("area"), F.size(geo.holes("rings")).alias("n_holes"), F.col("mean.x").alias("mean_x"), F.col("mean.y").alias("mean_y"), F.round("centroid.x", 6).alias("centroid_x"), F.round("centroid.y", 6).alias("centroid_y"))


@query(f"""with {STANDS_SQL}
select k, 1 as ring, 4 as n_points, 36.0::double as area from stands
union all select k, 2, 4, 4.0::double from stands where p_size % 2 = 0
union all select k, case when p_size % 2 = 0 then 3 else 2 end, 4, 2.0::double from stands where p_size % 3 = 0
union all select k, case when p_size % 2 = 0 then 3 else 2 end + case when p_size % 3 = 0 then 1 else 0 end, 8, 4.185185::double from stands where p_size % 5 = 0""")
def path_ops_to_rings(spark, sf_dir):
    """Drawing operations to rings: an operation that doesn't start where the last ended opens a ring, a closed shape is
    one of its own, and a curve is six chords."""
    from atrium.operators.drawing import rings_of

    s = venue.stands(spark, sf_dir)
    line = lambda ax, ay, bx, by: F.struct(F.lit("l").alias("op"), F.array(geo.point(ax, ay), geo.point(bx, by)).alias("points"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    outer = [line(x0, y0, x1, y0), line(x1, y0, x1, y1), line(x1, y1, x0, y1), line(x0, y1, x0, y0)]
    a, b, c, d = x0 + 1, y0 + 1, x0 + 3, y0 + 3
    inner = [line(a, b, c, b), line(c, b, c, d), line(c, d, a, d), line(a, d, a, b)]
    tiny = [line(x1, y1, x1 + 0.5, y1), line(x1 + 0.5, y1, x1 + 0.5, y1 + 0.5), line(x1 + 0.5, y1 + 0.5, x1, y1)]
    whole = F.struct(F.lit("re").alias("op"), F.array(geo.point(x0, y0), geo.point(x0 + 2, y0), geo.point(x0 + 2, y0 + 1), geo.point(x0, y0 + 1)).alias("points"))
    arc = F.struct(F.lit("c").alias("op"), F.array(geo.point(x0, y0), geo.point(x0, y0 + 2), geo.point(x0 + 3, y0 + 2), geo.point(x0 + 3, y0)).alias("points"))
    arch = [arc, line(x0 + 3, y0, x0 + 3, y0 - 0.5), line(x0 + 3, y0 - 0.5, x0, y0)]
    some = lambda n, own: F.when(F.col("p_size") % n == 0, F.array(*own)).otherwise(F.slice(F.array(*own), 1, 0))
    ops = s.select(F.col("k").alias("path_id"), F.posexplode(F.concat(F.array(*outer), some(2, inner), some(3, [whole]), F.array(*tiny), some(5, arch))).alias("seq", "o")).select("path_id", "seq", "o.op", "o.points")
    return rings_of(ops).select(F.col("path_id").alias("k"), "ring", F.size("points").alias("n_points"), F.round(F.abs(geo.ring_area("points")), 6).alias("area"))


@query(f"""with {FEATURES_SQL}
select * from (select venue, k, name, price as peso, row_number() over (partition by venue order by price desc, k) as pos from features) where pos <= 8""")
def worst_k_report(spark, sf_dir):
    """The top 8 of each venue, ties in drawing order."""
    rows = features(spark, sf_dir).selectExpr("venue", "k", "name", "price as peso", "row_number() over (partition by venue order by price desc, k) as pos")
    return rows.where("pos <= 8")


_TAGGED = """tagged as (select k, case k % 11 when 0 then 'via' when 1 then 'poi' when 2 then 'piso' when 3 then 'circulacao' when 4 then 'quadra' else kind end as kind, case k % 5 when 0 then 'servico' when 1 then null else cat end as cat, case when k % 3 <> 0 then nullif(name, '') end as name,
  case k % 4 when 0 then true when 1 then false end as mini, code, area_m2 from features)"""


@query(f"""with {FEATURES_SQL}, {_TAGGED}, l as ({' union all '.join(f"select {n} as ord, '{layer}' as layer, k, name, code, area_m2 from tagged where {rule}" for n, (layer, rule) in enumerate(params.LAYERS.items()))})
select ord, layer, count(*) as n, count(coalesce(name, code)) as labelled, min(-coalesce(area_m2, 0))::double as first_key from l group by ord, layer""")
def key_presence_layers(spark, sf_dir):
    """The style layers' conditions on key presence, the label's fallback and the collision priority."""
    rows = features(spark, sf_dir).selectExpr(
        "k", "case k % 11 when 0 then 'via' when 1 then 'poi' when 2 then 'piso' when 3 then 'circulacao' when 4 then 'quadra' else kind end as kind", "case k % 5 when 0 then 'servico' when 1 then null else cat end as cat",
        "case when k % 3 <> 0 then nullif(name, '') end as name", "case k % 4 when 0 then true when 1 then false end as mini", "code", "area_m2",
    )
    layer = F.array(*[F.when(F.expr(rule), F.struct(F.lit(n).alias("ord"), F.lit(name).alias("layer"))) for n, (name, rule) in enumerate(params.LAYERS.items())])
    shown = rows.withColumn("l", F.explode(F.filter(layer, lambda x: x.isNotNull()))).select("l.ord", "l.layer", "name", "code", "area_m2")
    return shown.groupBy("ord", "layer").agg(F.count("*").alias("n"), F.count(F.coalesce("name", "code")).alias("labelled"), F.min(-F.coalesce("area_m2", F.lit(0.0))).alias("first_key"))


@query(f"""with {STANDS_SQL} select k, round_even((k % 511) / 510.0::double * 255, 0)::int as v, round_even((k % 256) / 255.0::double * 255, 0)::int as back from stands""")
def rgb_from_floats(spark, sf_dir):
    """Colour channels from 0..1 to whole numbers, halves to even."""
    s = venue.stands(spark, sf_dir).selectExpr("k", "(k % 511) / 510.0D as c", "(k % 256) / 255.0D as d")
    return s.select("k", rgb_ints("c").alias("v"), rgb_ints("d").alias("back"))


@query("""with p as (select l_orderkey as page, l_linenumber as seq, (l_quantity::int % 4) as level, case when l_partkey % 3 = 0 then 'clip' when l_partkey % 11 = 0 then 'group' else 'f' end as type, l_suppkey % 5 <> 0 as filled,
  (l_partkey % 100)::double as x0, (l_suppkey % 60)::double as y0, (l_partkey % 100 + 10 + l_linenumber)::double as x1, (l_suppkey % 60 + 12)::double as y1, l_partkey, l_suppkey, l_extendedprice from lineitem),
o as (select *, row_number() over (partition by page order by seq, l_partkey, l_suppkey, l_extendedprice) as n from p),
c as (select a.page, a.n, max(b.n) as clip from o a join o b on b.page = a.page and b.n < a.n and b.type = 'clip' where b.level < (select min(m.level) from o m where m.page = a.page and m.n > b.n and m.n <= a.n) group by a.page, a.n)
select a.page, a.n as seq from o a left join c on c.page = a.page and c.n = a.n left join o k on k.page = a.page and k.n = c.clip
where a.type = 'f' and a.filled and greatest(a.x0, 5) < least(a.x1, 90) and greatest(a.y0, 0) < least(a.y1, 50) and (k.n is null or greatest(a.x0, k.x0) < least(a.x1, k.x1) and greatest(a.y0, k.y0) < least(a.y1, k.y1))""")
def drawing_scan(spark, sf_dir):
    """The filled paths of each page that its clips and the read window let through."""
    from atrium.operators.drawing import visible_paths

    rows = venue.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as page", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as seq", "cast(l_quantity as int) % 4 as level", "case when l_partkey % 3 = 0 then 'clip' when l_partkey % 11 = 0 then 'group' else 'f' end as type", "l_suppkey % 5 <> 0 as filled",
                                                             "cast(l_partkey % 100 as double) as x0", "cast(l_suppkey % 60 as double) as y0", "cast(l_partkey % 100 + 10 + l_linenumber as double) as x1", "cast(l_suppkey % 60 + 12 as double) as y1")
    return visible_paths(rows, (5.0, 0.0, 90.0, 50.0)).select("page", "seq")


@query(f"""with {FEATURES_SQL}
select venue, k, label, row_number() over (partition by venue order by entrance, sort_key, k) as pos from (
  select venue, k, coalesce(name, code) as label, case when kind = 'area' then 0 else 1 end as entrance, -price as sort_key from features)""")
def label_priority(spark, sf_dir):
    rows = features(spark, sf_dir).selectExpr("venue", "k", "coalesce(name, code) as label", "case when kind = 'area' then 0 else 1 end as entrance", "-price as sort_key")
    return rows.selectExpr("venue", "k", "label", "row_number() over (partition by venue order by entrance, sort_key, k) as pos")


@query(f"""with {STANDS_SQL}
select count(*) as sides, round(avg(100 * least(l % 1, 1 - l % 1)), 9) as deviation_cm from (select unnest([(x1 - x0) + 0.01 * (k % 9), (y1 - y0) - 0.02 * (k % 4), (x1 - x0) + 0.01 * (k % 9), (y1 - y0) - 0.02 * (k % 4)]) as l from stands) where l > 0.5 and l < 40""")
def module_deviation(spark, sf_dir):
    """Mean distance of the sides' lengths from whole metres."""
    s = venue.stands(spark, sf_dir).selectExpr("explode(array((x1 - x0) + 0.01D * (k % 9), (y1 - y0) - 0.02D * (k % 4), (x1 - x0) + 0.01D * (k % 9), (y1 - y0) - 0.02D * (k % 4))) as l")
    return s.where("l > 0.5 and l < 40").agg(F.count("*").alias("sides"), F.round(F.avg(100 * geo.module_deviation("l", F.lit(1.0))), 9).alias("deviation_cm"))
