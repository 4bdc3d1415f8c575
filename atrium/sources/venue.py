"""Venues made from the star-schema tables: the inputs of the venue operators.

Every relation is plain column arithmetic on its table, so filters and projections reach the files. A venue is VENUE_ROWS rows of ROW_STANDS stands; tables of more parts
make more venues, and ``venue`` is the key that operators deal and group by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_STANDS, VENUE_ROWS = 20, 100
WIDTH = 140
LETTERS = "ABCDEFGHIJK"
#: Colour of each kind of part, before its tint.
COLOURS = {
    "STANDARD": (187, 230, 251), "ECONOMY": (237, 33, 36), "MEDIUM": (250, 238, 19),
    "PROMO": (179, 127, 184), "SMALL": (192, 226, 202), "LARGE": (250, 163, 26),
}

#: The same relation in DuckDB, as the first member of a WITH clause.
STANDS_SQL = """
stands0 as (select p_partkey as k, p_partkey // 20 as "row", p_partkey % 20 as col, upper(p_name) as name, p_type, p_size, p_brand, p_retailprice as price from part),
stands as (select k, k as ord, "row", col, "row" // 100 as venue, name, p_type, p_size, p_brand, price,
  (4 + 6 * col + 4 * (col // 5))::double as x0, (10 + 6 * col + 4 * (col // 5))::double as x1, (4 + 10 * ("row" % 100))::double as y0, (10 + 10 * ("row" % 100))::double as y1,
  substr('ABCDEFGHIJK', ("row" % 11 + 1)::int, 1) || lpad((col * 2)::varchar, 2, '0') as code,
  case p_type when 'STANDARD' then 187 when 'ECONOMY' then 237 when 'MEDIUM' then 250 when 'PROMO' then 179 when 'SMALL' then 192 else 250 end as r,
  (case p_type when 'STANDARD' then 230 when 'ECONOMY' then 33 when 'MEDIUM' then 238 when 'PROMO' then 127 when 'SMALL' then 226 else 163 end) + p_size % 5 as g,
  case p_type when 'STANDARD' then 251 when 'ECONOMY' then 36 when 'MEDIUM' then 19 when 'PROMO' then 184 when 'SMALL' then 202 else 26 end as b
  from stands0)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rectangle a part: k, ord, row, col, venue, x0, x1, y0, y1, code, name and a colour.

    A part is a few bytes in its file but its geometry is long work: parts are dealt by key to a set number of
    tasks, or one would read, and so work out, a hundred thousand of them and more.
    """
    kind = lambda i: F.coalesce(*[F.when(F.col("p_type") == t, c[i]) for t, c in COLOURS.items()], F.lit(COLOURS["LARGE"][i]))
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as k", f"p_partkey div {ROW_STANDS} as row", f"p_partkey % {ROW_STANDS} as col", "upper(p_name) as name", "p_type", "p_size", "p_brand", "p_retailprice as price").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    rows = rows.selectExpr(
        "k", "k as ord", "row", "col", f"row div {VENUE_ROWS} as venue", "name", "p_type", "p_size", "p_brand", "price",
        "cast(4 + 6 * col + 4 * (col div 5) as double) as x0", "cast(10 + 6 * col + 4 * (col div 5) as double) as x1",
        f"cast(4 + 10 * (row % {VENUE_ROWS}) as double) as y0", f"cast(10 + 10 * (row % {VENUE_ROWS}) as double) as y1",
        f"concat(substring('{LETTERS}', cast(row % {len(LETTERS)} + 1 as int), 1), lpad(cast(col * 2 as string), 2, '0')) as code",
    )
    return rows.withColumns({"r": kind(0), "g": kind(1) + F.col("p_size") % 5, "b": kind(2)})


def venues(spark: SparkSession, sf_dir: str) -> int:
    """How many venues the parts make."""
    return max(1, -(-table(spark, sf_dir, "part").count() // (ROW_STANDS * VENUE_ROWS)))


#: The same number in DuckDB.
VENUES_SQL = "nv as (select greatest(1, (count(*) + 1999) // 2000)::bigint as nv from part)"


def doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One door a supplier, on the west wall of the first venue."""
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey as door", "s_name as name", "2.0D as x", "cast(4 + 10 * (s_suppkey % 10) + 8 as double) as y")


DOORS_SQL = "doors as (select s_suppkey as door, s_name as name, 2.0::double as x, (4 + 10 * (s_suppkey % 10) + 8)::double as y from supplier)"


def visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tap on the map a customer, anywhere in the venues."""
    n = venues(spark, sf_dir)
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as visitor", f"c_custkey % {n}L as venue", f"cast((c_custkey * 37) % {WIDTH} as double) + 0.25 as x", "cast((c_custkey * 53) % 1000 as double) + 0.25 as y")


VISITORS_SQL = f"{VENUES_SQL}, visitors as (select c_custkey as visitor, c_custkey % nv as venue, ((c_custkey * 37) % 140)::double + 0.25 as x, ((c_custkey * 53) % 1000)::double + 0.25 as y from customer, nv)"
