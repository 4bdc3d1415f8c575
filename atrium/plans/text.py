"""Queries on names, titles, search and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium.functions import text as txt
from atrium.operators.search import build_index, search
from atrium.sources import venue
from atrium.sources.venue import STANDS_SQL

from .features import FEATURES_SQL, features
from .registry import query

_PARTICLES = "('de', 'da', 'do', 'das', 'dos', 'e', 'em', 'a', 'o')"


@query(f"""with n as (select p_partkey as k, upper(p_name) || ' DE ' || upper(p_brand) || ' E  a' as name from part),
w as (select k, [x for x in regexp_split_to_array(trim(lower(name)), '\\s+') if x <> ''] as ws from n)
select k, array_to_string([case when i > 1 and ws[i] in {_PARTICLES} then ws[i] else upper(ws[i][1:1]) || ws[i][2:] end for i in range(1, len(ws) + 1)], ' ') as title from w""")
def title_case_names(spark, sf_dir):
    rows = venue.table(spark, sf_dir, "part").selectExpr("p_partkey as k", "concat(upper(p_name), ' DE ', upper(p_brand), ' E  a') as name")
    return rows.select("k", txt.title_case("name").alias("title"))


@query("""with i as (select doc_id as ord, regexp_extract(text, '^[^\\s]+\\s+[^\\s]+') as name, 'A' || lpad((doc_id % 1000)::varchar, 3, '0') as code from documents),
f as (select ord, coalesce(nullif(name, ''), code) as name, code, strip_accents(lower(coalesce(nullif(name, ''), code))) as nn, lower(code) as cn from (select ord, case when ord % 9 = 0 then '' else name end as name, case when ord % 6 = 0 then '' else code end as code from i) i2 where name <> '' or code <> ''),
r as (select ord, name, code, case when starts_with(nn, 'es') or starts_with(cn, 'es') then 0 when contains(nn, 'es') then 1 end as rank from f)
select ord, name, nullif(code, '') as code, rank from r where rank is not null order by rank, ord limit 30""")
def search_prefix_then_contains(spark, sf_dir):
    rows = venue.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.regexp_extract("text", r"^[^\s]+\s+[^\s]+", 0).alias("name"), F.concat(F.lit("A"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0")).alias("code"), F.lit("estande").alias("kind"), F.lit(None).cast("string").alias("cat"))
    rows = rows.withColumns({"name": F.when(F.col("ord") % 9 == 0, "").otherwise(F.col("name")), "code": F.when(F.col("ord") % 6 == 0, "").otherwise(F.col("code"))})
    return search(build_index(rows), "  Es ").select("ord", "name", "code", "rank")


@query(f"""with {FEATURES_SQL}, c as (select k, kind, cat, case k % 7 when 0 then 'TL' || lpad((k % 48)::varchar, 2, '0') when 1 then 'TI' || lpad((k % 31)::varchar, 2, '0') when 2 then null when 3 then 'AA' || (k % 50)::varchar when 4 then 'Z9' else code end as code from features)
select k, case when kind = 'area' then case cat when 'alimentacao' then 'Alimentação' when 'cultural' then 'Espaço cultural' when 'infra' then 'Serviços' else 'Área' end
  when code is null then 'Estande' when starts_with(code, 'TL') then 'Lugar nº ' || substr(code, 3)::int::varchar || ' · Travessa Literária' when starts_with(code, 'TI') then 'Estande ' || code || ' · Alameda dos Artistas'
  when regexp_matches(code, '^(AA|BB|CC|DD|[A-K])[0-9]') then 'Estande ' || code || ' · Rua ' || regexp_extract(code, '^(AA|BB|CC|DD|[A-K])[0-9]', 1) else 'Estande ' || code end as subtitle from c""")
def subtitle_labels(spark, sf_dir):
    rows = features(spark, sf_dir).withColumn("code", F.expr("case k % 7 when 0 then concat('TL', lpad(cast(k % 48 as string), 2, '0')) when 1 then concat('TI', lpad(cast(k % 31 as string), 2, '0')) when 2 then null when 3 then concat('AA', cast(k % 50 as string)) when 4 then 'Z9' else code end"))
    return rows.select("k", txt.subtitle("kind", "cat", "code").alias("subtitle"))


@query(f"""with {STANDS_SQL}
select k, 'TL' || lpad((k % 48 + 1)::varchar, 2, '0') as booth, replace(replace(replace(replace('<' || name || ' & "' || p_brand || '">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as escaped,
  printf('#%02x%02x%02x', r, g, b) as colour, chr((65 + k % 26)::int) as letter, 'Transversal ' || lpad((k % 30 + 1)::varchar, 2, '0') as way from stands""")
def format_helpers(spark, sf_dir):
    s = venue.stands(spark, sf_dir)
    raw = F.concat(F.lit("<"), "name", F.lit(' & "'), "p_brand", F.lit('">'))
    return s.select("k", F.format_string("TL%02d", F.col("k") % 48 + 1).alias("booth"), txt.escape_html(raw).alias("escaped"), txt.hex_colour("r", "g", "b").alias("colour"), txt.letter("k").alias("letter"), F.format_string("Transversal %02d", F.col("k") % 30 + 1).alias("way"))


@query(f"""with {STANDS_SQL}, h as (select coalesce(code, name) as key, k, name, row_number() over (partition by venue, coalesce(code, name) order by ord desc) as n, venue from stands)
select venue, key, k, name from h where n = 1""")
def hit_lookup_last_wins(spark, sf_dir):
    """Of features with one key the last in drawing order answers a tap."""
    s = venue.stands(spark, sf_dir).withColumn("key", F.coalesce("code", "name"))
    return s.groupBy("venue", "key").agg(F.max_by(F.struct("k", "name"), "ord").alias("h")).select("venue", "key", "h.k", "h.name")
