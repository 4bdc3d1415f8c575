"""Search over named features: a folded index, ranked prefix then substring hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium import params
from atrium.functions.geometry import vertex_mean
from atrium.functions.text import fold


def build_index(features: DataFrame) -> DataFrame:
    """``features`` (ord, kind, cat, code, name) that are stands or areas with a name or code, folded.

    An empty name or code counts as none. Where the features have a ring, centre is the mean of its vertices.
    """
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    hits = features.withColumns({"code": given("code"), "name": F.coalesce(given("name"), given("code"))}).where(F.col("kind").isin("estande", "area") & F.col("name").isNotNull())
    if "ring" in features.columns:
        hits = hits.withColumn("centre", vertex_mean("ring"))
    return hits.withColumns({"name_norm": fold("name"), "code_norm": fold("code")})


def search(index: DataFrame, text: str, limit: int = params.SEARCH_LIMIT) -> DataFrame:
    """At most ``limit`` hits: prefixes of name or code first, then parts of the name, each in index order."""
    asked = fold(F.trim(F.lit(text)))
    prefix = F.col("name_norm").startswith(asked) | F.coalesce(F.col("code_norm").startswith(asked), F.lit(False))
    ranked = index.withColumn("rank", F.when(prefix, 0).when(F.col("name_norm").contains(asked), 1))
    return ranked.where(F.col("rank").isNotNull() & (F.length(asked) > 0)).orderBy("rank", "ord").limit(limit)
