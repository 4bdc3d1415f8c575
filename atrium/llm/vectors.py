"""Vector rows shared by the two embedding operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: no null id, no null, empty or zero
    vector, and none with null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return frame.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def of_one_length(vectors: DataFrame, v: str = "v") -> DataFrame:
    """The rows whose vector has the most frequent length, the longer of equals: others can't be compared with them."""
    top = vectors.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return vectors.where(F.size(v) == (top["n"] if top else 0))


def matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(x, dtype=np.float64) for x in vectors]) if len(vectors) else np.zeros((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component is taken out first, so nothing overflows."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``: equal vectors get equal values,
    wherever they stand, which a matrix product doesn't promise."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def bounded_sample(vectors: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` distinct unit vectors, chosen by a hash of the vector: a documented bound."""
    hashed = vectors.select(F.xxhash64("v").alias("h"), "v")
    share = min(1.0, 8 * most / max(1, vectors.count()))  # thinned by the hash, so that a task sorts a few times the sample
    thin = hashed.where(F.pmod("h", F.lit(1_000_000)) <= int(share * 1_000_000))
    distinct = thin.orderBy(F.pmod("h", F.lit(1_000_000)), "h").limit(4 * most).dropDuplicates(["h"]).orderBy(F.pmod("h", F.lit(1_000_000)), "h").limit(most)
    rows = [r["v"] for r in distinct.collect()]
    return unit(matrix(rows)) if rows else np.zeros((0, 0))
