"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than the six ASCII white-space characters.
#: ``bytes.split()`` cuts at exactly these, so UTF-8 bytes are split rather than str.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir or, where that is unset, one in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text) -> F.Column:
    """Number of words of a text column as long; 0 for null."""
    bare = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(bare, SPACE_CLASS))).cast("long")


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Component of every node that ``edges`` touch, as (node, component): the smallest node reachable.

    Alternating large-star and small-star rounds. Each round is two aggregations, which combine
    before they shuffle, and two equi-joins, so a hub is never gathered in one task. Self-loops
    give a node of its own component; null ends are ignored. Nodes without edges are not returned.
    Edges, rounds and result are written, so no plan holds another: many plans of many stages fill the driver.
    So do many small broadcasts, each with a table, threads and stacks of its own there: no join is one.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    pairs = materialise(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")  # the edges' own plan runs once
    stars = pairs.where("u <> v")
    while True:
        # u is the larger end throughout, so the least neighbour of a node is found where it is u.
        least = stars.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = stars.join(least.hint("merge"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        stars = materialise(small.where("u <> v").distinct(), "cc")
        ends = stars.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(stars.select("v", F.lit(0), F.lit(1)))
        deep = ends.groupBy("node").agg((F.sum("up") + F.max("down") > 1).alias("deep"), F.max("up").alias("up")).where("deep and up = 1")
        if deep.isEmpty():
            break
    # Every v is a root now; a self-loop names its node, which roots or leaves may be already.
    roots = stars.select(F.col("v").alias("node")).union(pairs.where("u = v").select("u")).distinct().join(stars.select(F.col("u").alias("node")).hint("merge"), "node", "left_anti")
    return materialise(stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component"))), "components")
