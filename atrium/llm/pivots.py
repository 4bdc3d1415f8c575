"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialise, table
from .multi_index import one_per_id
from .vectors import bounded_sample, exact_cosine, matrix, of_one_length, unit

THRESHOLD = 0.95
#: Reference points: one for so many distinct vectors, at most MAX_PIVOTS, no two closer than APART.
ROWS_PER_PIVOT, MIN_PIVOTS, MAX_PIVOTS, APART = 25, 64, 8192, 0.7
#: Each vector is described by its PREFIX nearest points in order; candidates share at least SHARED.
PREFIX, SHARED = 10, 3
SLICE = 256


def spread(points: np.ndarray, apart: float) -> np.ndarray:
    """The points in order, but for those whose cosine with an earlier kept one reaches ``apart``:
    else a large group of near copies would fill its own neighbourhood with reference points."""
    kept = np.empty_like(points)
    n = 0
    for p in points:
        if not n or (kept[:n] @ p).max() < apart:
            kept[n], n = p, n + 1
    return kept[:n]


def tile_links(left: pd.DataFrame, right: pd.DataFrame, pivot: int, threshold: float, shared: int) -> pd.DataFrame:
    """Verified links of one tile of a pivot's list whose smallest shared pivot is this one.

    Per vector: copies it links with, and the smallest vector of its component in the tile; so a
    tile gives at most one row a vector, however many links it holds.
    """
    same = left is right
    a, b = matrix(left["v"]), matrix(right["v"])
    pa, pb = np.stack(left["prefix"].to_numpy()), np.stack(right["prefix"].to_numpy())
    counts = np.zeros((len(a), len(b)), dtype=np.int16)
    for c in range(pa.shape[1]):
        counts += (pa[:, c][:, None, None] == pb[None]).any(axis=2)
    i, j = np.nonzero((counts >= min(shared, pa.shape[1])) & (unit(a) @ unit(b).T >= threshold - 1e-9))
    if same:
        i, j = i[i < j], j[i < j]
    common = (pa[i][:, :, None] == pb[j][:, None, :]).any(axis=2)
    fine = np.where(common, pa[i], np.iinfo(np.int32).max).min(axis=1) == pivot
    i, j = i[fine], j[fine]
    fine = exact_cosine(a[i], b[j]) >= threshold
    i, j = i[fine], j[fine]
    ids = np.concatenate([left["vec_id"].to_numpy(), right["vec_id"].to_numpy()]) if not same else left["vec_id"].to_numpy()
    copies = np.concatenate([left["copies"].to_numpy(), right["copies"].to_numpy()]) if not same else left["copies"].to_numpy()
    j = j if same else j + len(left)
    links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
    root = ids.copy()
    while True:  # the smallest id spreads along the links, and each root takes its own root's
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (root == before).all():
            break
    hit = links > 0
    return pd.DataFrame({"vec_id": ids[hit], "links": links[hit].astype(np.int64), "root": root[hit]})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links between rows of (vec_id, v) with a cosine of at least ``threshold``.

    Returns vec_id, n_links, component_id: other vectors linked directly, and the smallest vec_id
    reachable. Equal vectors count as links but are compared once. The reference points come from a
    bounded sample; every vector is indexed. Vectors of another length than most don't come back. No
    rows give no rows.
    """
    spark = vectors.sparkSession
    vectors = of_one_length(vectors)
    classes = materialise(vectors.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.xxhash64("v").alias("class")), "vector-classes")
    n = classes.count()
    most = int(min(MAX_PIVOTS, max(MIN_PIVOTS, n // ROWS_PER_PIVOT)))
    points = spread(bounded_sample(classes, 2 * most), APART)[:most] if n else np.zeros((0, 0))
    if not len(points):
        return spark.createDataFrame([], "vec_id long, n_links long, component_id long")
    k = min(PREFIX, len(points))

    def describe(batches):
        for frame in batches:
            if len(frame):
                near = unit(matrix(frame["v"])) @ points.T
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
                yield frame.assign(prefix=list(np.take_along_axis(top, order, axis=1).astype(np.int32)))

    described = classes.selectExpr("rep as vec_id", "v", "copies").mapInPandas(describe, "vec_id long, v array<double>, copies long, prefix array<int>")
    lists = materialise(described.select("*", F.explode("prefix").alias("pivot")), "pivot-lists")
    lengths = lists.groupBy("pivot").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))  # MAX_PIVOTS rows at most
    sliced = lists.join(F.broadcast(lengths), "pivot").withColumn("own", F.pmod(F.xxhash64("vec_id"), "slices").cast("int"))
    tiled = sliced.select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    tiled = tiled.select("vec_id", "v", "copies", "prefix", "pivot", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pivot, a, b = (int(x) for x in key)
        left = rows[rows["own"] == a]
        right = left if a == b else rows[rows["own"] == b]
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_id": [], "links": [], "root": []})
        return tile_links(left, right, pivot, threshold, SHARED)

    found = materialise(tiled.groupBy("pivot", "a", "b").applyInPandas(verify, "vec_id long, links long, root long"), "vector-links")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("vec_id <> root"), "vec_id", "root").withColumnRenamed("node", "vec_id")
    reps = classes.selectExpr("rep as vec_id", "class", "copies").join(links, "vec_id", "left").join(groups, "vec_id", "left")
    reps = reps.select("class", F.col("vec_id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return vectors.select("vec_id", F.xxhash64("v").alias("class")).join(reps, "class").select("vec_id", "n_links", "component_id")


def op7_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that take no part have no links and stand alone; a null vec_id isn't a row."""
    raw = table(spark, sf_dir, "embeddings")
    vectors = materialise(one_per_id(raw), "vectors")
    every = raw.select(F.col("vec_id").cast("long")).where("vec_id is not null").distinct()
    out = every.join(near_duplicates(vectors), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


ORACLE = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
l as (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
r(node, root) as (select vec_id, vec_id from v union select l.y, r.root from r join l on r.node = l.x where l.y > r.root),
c as (select node, min(root) as component_id from r group by node),
n as (select x, count(*) as n_links from l group by x)
select c.node as vec_id, coalesce(n.n_links, 0)::bigint as n_links, c.component_id, c.node = c.component_id as kept
from c left join n on n.x = c.node
"""
