"""Measures of a map's quality: fidelity, invariants, scale, coverage, anchoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium import params
from atrium.functions import geometry as geo

from .labels import cell_of, cells_of_box, cells_of_segment

BOX = ("x0", "y0", "x1", "y1")


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """One row, median: the value at position n // 2 in order; the upper of two middle ones.

    Values are counted first, so what is ranked is one row per distinct value, and the ranks come
    from a running sum over ranges that the data's own quantiles cut.
    """
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    cuts = rows.stat.approxQuantile(value, [i / 32 for i in range(1, 32)], 0.01)
    edges = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    ranged = counts.withColumn("part", F.size(F.filter(edges, lambda c: c < F.col("v"))))
    parts = ranged.groupBy("part").agg(F.sum("n").alias("s")).selectExpr("part", "coalesce(sum(s) over (order by part rows between unbounded preceding and 1 preceding), 0) as below")
    at = ranged.join(F.broadcast(parts), "part").selectExpr("v", "n", "below + sum(n) over (partition by part order by v) as upto")
    return at.crossJoin(F.broadcast(total)).where("upto > total div 2 and upto - n <= total div 2").select(F.col("v").alias("median"))


def iou_match(expected: DataFrame, model: DataFrame, key: str = "venue") -> DataFrame:
    """``expected`` (key, ord, category, box) with the model box (key, mord) of largest overlap and its iou, the first of equals."""
    e = expected.withColumn("cell", F.explode(cells_of_box(*BOX)))
    m = model.select(key, "mord", *[F.col(c).alias(f"m{c}") for c in BOX], F.explode(cells_of_box(*BOX)).alias("cell"))
    pairs = e.join(m, [key, "cell"]).select(key, "ord", "mord", geo.box_iou(BOX, [f"m{c}" for c in BOX]).alias("iou"), F.hypot(F.expr("(mx0 + mx1 - x0 - x1) / 2"), F.expr("(my0 + my1 - y0 - y1) / 2")).alias("drift")).where("iou > 0").distinct()
    best = pairs.groupBy(key, "ord").agg(F.min(F.struct((-F.col("iou")).alias("i"), "mord", "drift")).alias("b"))
    return expected.join(best.select(key, "ord", "b.mord", (-F.col("b.i")).alias("iou"), "b.drift"), [key, "ord"], "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))


def iou_with_parts(matched: DataFrame, model: DataFrame, least: float = params.IOU_MIN, key: str = "venue") -> DataFrame:
    """``matched`` with the shapes below ``least`` compared with the union of the model's boxes whose centre lies inside
    them, where that is better: a block may have been cut into cells. Boxes of one block don't overlap."""
    weak = matched.where(F.col("iou") < least).withColumn("cell", F.explode(cells_of_box(*BOX)))
    m = model.selectExpr(key, *[f"{c} as m{c}" for c in BOX], "(x0 + x1) / 2 as mx", "(y0 + y1) / 2 as my").withColumn("cell", cell_of("mx", "my"))
    inner = "greatest(0D, least(x1, mx1) - greatest(x0, mx0)) * greatest(0D, least(y1, my1) - greatest(y0, my0))"
    parts = weak.join(m, [key, "cell"]).where("mx > x0 and mx < x1 and my > y0 and my < y1").selectExpr(key, "ord", "(x1 - x0) * (y1 - y0) as own", "(x0 + x1) / 2 as cx", "(y0 + y1) / 2 as cy", f"{inner} as both", "(mx1 - mx0) * (my1 - my0) as area", "mx", "my")
    per = parts.groupBy(key, "ord").agg(
        (F.sum("both") / (F.first("own") + F.sum("area") - F.sum("both"))).alias("u_iou"),
        F.hypot(F.sum(F.expr("mx * area")) / F.sum("area") - F.first("cx"), F.sum(F.expr("my * area")) / F.sum("area") - F.first("cy")).alias("u_drift"),
    )
    better = F.coalesce(F.col("u_iou") > F.col("iou"), F.lit(False))
    out = matched.join(per, [key, "ord"], "left")
    return out.withColumns({"drift": F.when(better, F.col("u_drift")).otherwise(F.col("drift")), "iou": F.when(better, F.col("u_iou")).otherwise(F.col("iou"))}).drop("u_iou", "u_drift")


def fidelity(matched: DataFrame, least: float = params.IOU_MIN) -> DataFrame:
    """(category, total, faithful, ratio, drift_cm) of matched shapes."""
    fine = F.sum(F.when(F.col("iou") >= least, 1).otherwise(0))
    return matched.groupBy("category").agg(F.count("*").alias("total"), fine.alias("faithful"), F.round(fine / F.count("*"), 4).alias("ratio"), F.round(F.max("drift") * 100, 2).alias("drift_cm"))


def crossing_blocks(ways: DataFrame, blocks: DataFrame, erode: float = 0.3, least: float = 0.5, key: str = "venue") -> DataFrame:
    """The ways (key, ord) that run over ``least`` metres inside a block less its rim.

    Ways are lines in any direction (key, ord, ax, ay, bx, by), of which one may have several; blocks are
    convex rings (key, ring) or boxes (key, x0..y1). Both meet on grid cells; a way's lines inside one block add up.
    """
    if "ring" not in blocks.columns:
        blocks = blocks.withColumn("ring", geo.rectangle(*BOX))
    box = geo.ring_bbox("ring")
    b = blocks.select(key, F.col("ring").alias("_ring"), F.monotonically_increasing_id().alias("_block"), *[box[c].alias(c) for c in BOX])
    b = b.select(key, "_ring", "_block", F.explode(cells_of_box(*BOX)).alias("cell"))
    w = ways.select(key, "ord", *[F.col(c).alias(f"_{c}") for c in ("ax", "ay", "bx", "by")]).withColumn("_line", F.monotonically_increasing_id())
    near = w.withColumn("cell", F.explode(cells_of_segment("_ax", "_ay", "_bx", "_by"))).join(b, [key, "cell"])
    run = near.groupBy(key, "ord", "_line", "_block").agg(F.max(geo.run_inside("_ax", "_ay", "_bx", "_by", "_ring", erode)).alias("m"))
    return run.groupBy(key, "ord", "_block").agg(F.sum("m").alias("m")).where(F.col("m") > least).select(key, "ord").distinct()


def untouched_blocks(blocks: DataFrame, corridors: DataFrame, reach: float = 0.6, key: str = "venue") -> DataFrame:
    """Blocks with no corridor box within ``reach``."""
    c = corridors.select(F.col(key), *[F.col(x).alias(f"c{x}") for x in BOX], F.explode(cells_of_box(*BOX)).alias("cell"))
    near = blocks.select(key, "ord", *BOX, F.explode(cells_of_box(*BOX, reach)).alias("cell")).join(c, [key, "cell"])
    touched = near.where(f"greatest(cx0 - x1, x0 - cx1, 0) * greatest(cx0 - x1, x0 - cx1, 0) + greatest(cy0 - y1, y0 - cy1, 0) * greatest(cy0 - y1, y0 - cy1, 0) <= {reach * reach}").select(key, "ord").distinct()
    return blocks.join(touched, [key, "ord"], "left_anti")


def outside_building(blocks: DataFrame, building: DataFrame, least: float = 0.5, key: str = "venue") -> DataFrame:
    """``blocks`` with more than ``least`` square metres outside their venue's building, with outside_m2 and share in percent.

    Blocks are convex rings (ring) or boxes (x0..y1); ``building`` (key, ring) has one simple ring a venue. A venue
    without one has no inside. The building is cut at the block's sides, in column expressions.
    """
    own = F.col("ring") if "ring" in blocks.columns else geo.rectangle(*BOX)
    rows = blocks.withColumn("_block", own).join(building.select(key, F.col("ring").alias("_building")), key, "left")
    # Cut by a generator, so that no filter or sum over the cut ring has it cut again.
    rows = rows.select("*", F.explode(F.array(geo.clipped("_building", "_block"))).alias("_inside"))
    rows = rows.withColumns({"_area": F.abs(geo.ring_area("_block")), "_within": F.coalesce(F.abs(geo.ring_area("_inside")), F.lit(0.0))})
    rows = rows.withColumn("outside_m2", F.round(F.col("_area") - F.col("_within"), 9)).where(F.col("outside_m2") > least)
    return rows.withColumn("share", F.round(100 * F.col("outside_m2") / F.col("_area"), 1)).drop("_block", "_building", "_inside", "_area", "_within")


def scale_sweep(sides: DataFrame, low: float, high: float, step: float, by: tuple = (), times: str = "1") -> DataFrame:
    """The scale with the smallest mean module deviation of ``sides`` (length), of equals the smaller; by axis or
    resample if asked, each side counting ``times``.

    Lengths are counted first: a sweep meets each distinct length once.
    """
    spark = sides.sparkSession
    counts = sides.groupBy(*by, "length").agg(F.sum(F.expr(times)).alias("n"))
    scales = F.broadcast(spark.range(int(round((high - low) / step)) + 1).select((F.lit(low) + F.col("id") * step).alias("s")))  # a fixed number
    per = counts.crossJoin(scales).groupBy(*by, "s").agg((F.sum(geo.module_deviation("length", "s") * F.col("n")) / F.sum("n")).alias("dev"))
    return per.groupBy(*by).agg(F.min(F.struct(F.round("dev", 9).alias("dev"), "s")).alias("m")).select(*by, "m.s", "m.dev")


def isotropy(by_axis: DataFrame, slack: float = params.ISOTROPY) -> DataFrame:
    """One row (sx, sy, ratio, isotropic) of the best scale (axis, s) of both axes."""
    both = by_axis.agg(F.max(F.when(F.col("axis") == "x", F.col("s"))).alias("sx"), F.max(F.when(F.col("axis") == "y", F.col("s"))).alias("sy"))
    return both.withColumn("ratio", F.col("sy") / F.col("sx")).withColumn("isotropic", F.abs(F.col("ratio") - 1) <= slack)


def resamples(sides: DataFrame, draws: int, key: str = "k") -> DataFrame:
    """``sides`` in each of ``draws`` resamples, with draw and times: how often a row is in it, by a digest of
    (row, draw). A Poisson-like resample that needs no gathering and repeats itself."""
    digit = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("draw").cast("string")).cast("binary")), 1, 1), 16, 10).cast("int")
    times = F.element_at(F.array(*[F.lit(x) for x in (0, 0, 0, 1, 1, 1, 2, 3)]), digit % 8 + 1)
    return sides.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("times", times).where("times > 0")


def largest_canopy(canopies: DataFrame, key: str = "venue") -> DataFrame:
    """Of each venue's canopy boxes (key, ord, x0..y1) the widest, the first of equals."""
    return canopies.groupBy(key).agg(F.min(F.struct(F.expr("x0 - x1").alias("w"), "ord", *BOX)).alias("c")).select(key, "c.ord", *[f"c.{c}" for c in BOX])


def anchor_shift(doors: DataFrame, canopy: tuple, back_y: float, reach: int) -> DataFrame:
    """The whole-metre shift (dx, dy) with the least mean of both kinds of door's mean distance: public ones
    to the canopy box, service ones to the back wall. Of equals the first in order of (dx, dy)."""
    shifts = F.broadcast(doors.sparkSession.range((2 * reach + 1) ** 2).selectExpr(f"cast(id div {2 * reach + 1} as int) - {reach} as dx", f"cast(id % {2 * reach + 1} as int) - {reach} as dy"))  # a fixed number
    at = doors.crossJoin(shifts).withColumns({"px": F.expr("x + dx"), "py": F.expr("y + dy")})
    d = F.when(F.col("is_public"), geo.box_distance("px", "py", *[F.lit(float(c)) for c in canopy])).otherwise(F.abs(F.lit(back_y) - F.col("py")))
    per = at.groupBy("dx", "dy", "is_public").agg(F.avg(d).alias("m")).groupBy("dx", "dy").agg(F.round(F.avg("m"), 9).alias("cost"))
    return per.agg(F.min(F.struct("cost", "dx", "dy")).alias("m")).select("m.dx", "m.dy", "m.cost")
