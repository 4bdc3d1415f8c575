"""Walkable space and named corridors out of the grid's scan lines.

Corridors run along an axis. A scan line across it is cut into runs of cells by gaps-and-islands
windows; runs of fitting width are samples, samples that follow each other with a steady centre are
a track, and tracks get widths, extents and names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium import params


def dilate(flag: np.ndarray, radius: int) -> np.ndarray:
    """True within ``radius`` (Chebyshev) of a true cell: along each axis a window holds one if its running sums differ."""
    for axis in (1, 0):
        n = flag.shape[axis]
        at = np.arange(n)
        sums = np.insert(np.cumsum(flag, axis=axis), 0, 0, axis=axis)
        flag = np.take(sums, np.minimum(at + radius + 1, n), axis=axis) > np.take(sums, np.maximum(at - radius, 0), axis=axis)
    return flag


def erode(flag: np.ndarray, radius: int) -> np.ndarray:
    """The opposite of dilate on the complement; what lies outside the array doesn't count."""
    return ~dilate(~flag, radius)


def by_venue(cells: DataFrame, flag: str, of, key: str) -> DataFrame:
    """``cells`` (key, i, j, taken) with ``flag``: ``of`` maps taken[j, i] of a venue, a bounded array, to it. Cells are dealt by venue once."""

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].to_numpy() - rows["i"].min(), rows["j"].to_numpy() - rows["j"].min()
        taken = np.zeros((j.max() + 1, i.max() + 1), dtype=bool)
        taken[j, i] = rows["taken"].to_numpy(dtype=bool)
        return rows.assign(**{flag: of(taken)[j, i]})

    return cells.groupBy(key).applyInPandas(measure, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema) + f", {flag} boolean")


def between(flags: np.ndarray) -> np.ndarray:
    """True from the first true flag to the last."""
    return np.logical_or.accumulate(flags) & np.logical_or.accumulate(flags[::-1])[::-1]


def walkable(cells: DataFrame, closing: int, opening: int, key: str = "venue") -> DataFrame:
    """``cells`` (taken) with corridor: the closing of what is taken, less it, opened by ``opening``."""

    def corridor(taken: np.ndarray) -> np.ndarray:
        hull = erode(dilate(taken, closing), closing)
        return dilate(erode(hull & ~taken, opening), opening) & hull & ~taken

    return by_venue(cells, "corridor", corridor, key)


def walkable_with_apron(cells: DataFrame, closing: int = params.CLOSING_M, apron: int = params.APRON_M, opening: int = params.WIDTH_MIN // 2, key: str = "venue") -> DataFrame:
    """``cells`` (taken) with walkable: the closing of what is taken and an apron around it, inside the
    box of what is taken, less it, opened by ``opening``."""

    def walk(taken: np.ndarray) -> np.ndarray:
        inside = np.outer(between(taken.any(axis=1)), between(taken.any(axis=0)))
        open_ = (erode(dilate(taken, closing), closing) | dilate(taken, apron) & inside) & ~taken
        return dilate(erode(open_, opening), opening) & ~taken

    return by_venue(cells, "walkable", walk, key)


def scan_runs(cells: DataFrame, along: str, across: str, flag: str = "corridor", key: str = "venue") -> DataFrame:
    """(key, a, lo, hi, width, centre): the runs of true cells on each scan line; cells are one metre."""
    rows = cells.where(flag).selectExpr(key, f"{along} as a", f"{across} as b", f"{across} - row_number() over (partition by {key}, {along} order by {across}) as isle")
    runs = rows.groupBy(key, "a", "isle").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    return runs.selectExpr(key, "a", "lo", "hi", "hi - lo + 1 as width", "(lo + hi + 1) / 2.0D as centre")


def tracks(samples: DataFrame, axis: str = "axis", key: str = "venue", gap: float = params.GAP_M, tol: float = params.CENTRE_TOL) -> DataFrame:
    """``samples`` (key, axis, a, centre, width) with track: each sample goes to the first open track that ends at
    most ``gap`` before and ``tol`` beside it, else opens one. Greedy in order, so a kernel per venue and axis,
    over scan lines, not cells."""

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a", "centre"])
        ends: list[list[float]] = []
        out = []
        for a, c in zip(rows["a"], rows["centre"]):
            for n, (last, centre) in enumerate(ends):
                if a - last <= gap and a > last and abs(c - centre) <= tol:
                    ends[n] = [a, c]
                    out.append(n)
                    break
            else:
                out.append(len(ends))
                ends.append([a, c])
        return rows.assign(track=out)

    return samples.groupBy(key, axis).applyInPandas(follow, f"{key} long, {axis} string, a int, centre double, width int, track int")


def ways(tracked: DataFrame, axis: str = "axis", key: str = "venue") -> DataFrame:
    """(key, axis, track, centre, width, open, from, to, extent) of tracks of at least LENGTH_MIN samples.

    Centre and width are upper medians; a width over WIDTH_MAX is reported as that, with open set.
    """
    upper = lambda c: F.expr(f"array_sort(collect_list({c}))[cast(count(*) div 2 as int)]")
    per = tracked.groupBy(key, axis, "track").agg(upper("centre").alias("centre"), upper("width").alias("w"), F.min("a").alias("from"), F.max("a").alias("to"), F.count("*").alias("extent"))
    per = per.where(F.col("extent") >= params.LENGTH_MIN)
    return per.select(key, axis, "track", "centre", F.least("w", F.lit(params.WIDTH_MAX)).alias("width"), (F.col("w") > params.WIDTH_MAX).alias("open"), "from", "to", "extent")


def clip_ways(found: DataFrame, runs: DataFrame, axis: str = "axis", key: str = "venue") -> DataFrame:
    """``found`` cut to the corridor: extent and lines (array of from, to) of the pieces of a way's centre line
    that lie in the corridor and are at least as long as the way is wide; ways of under LENGTH_MIN in all go.

    ``runs`` (key, axis, a, lo, hi) as scan_runs gives them for both axes: a way along one axis lies on a scan
    line of the other. The last cell of a piece counts.
    """
    other = runs.select(key, F.when(F.col(axis) == "x", "y").otherwise("x").alias(axis), F.col("a").alias("line"), "lo", "hi")
    rows = found.drop("extent").withColumn("line", F.floor("centre").cast("int")).join(other.hint("merge"), [key, axis, "line"]).where("hi >= `from` and lo <= `to`")
    pieces = rows.withColumns({"lo": F.greatest("lo", "from"), "hi": F.least("hi", "to")}).where("hi - lo + 1 >= width")
    per = pieces.groupBy(key, axis, "track").agg(F.sum(F.expr("hi - lo + 1")).alias("extent"), F.array_sort(F.collect_list(F.struct(F.col("lo").alias("from"), F.col("hi").alias("to")))).alias("lines"))
    return found.drop("extent").join(per.where(F.col("extent") >= params.LENGTH_MIN), [key, axis, "track"])


def longest_piece(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Of the pieces (from, to) of each group the longest, the first of equals."""
    return pieces.groupBy(*by).agg(F.min(F.struct(F.expr("`from` - `to`").alias("n"), F.col("from"), F.col("to"))).alias("m")).select(*by, "m.from", "m.to")


def seed_ways(arrows: DataFrame, found: DataFrame, runs: DataFrame, axis: str = "axis", key: str = "venue") -> DataFrame:
    """Ways (as name_ways gives them) out of arrows (key, ord, name, axis, along, across) whose name no way has.

    The axis is the arrow's. Widths are taken at SEED_OFFSETS beside it, where the run across holds the
    axis and is WIDTH_MIN to WIDTH_OPEN wide; their upper median counts. The piece of the corridor that
    passes within PIECE_NEAR of the arrow, the first of several, must be LENGTH_MIN long. Of arrows with one name the first that succeeds counts.
    """
    a = arrows.join(found.select(key, "name").distinct(), [key, "name"], "left_anti")
    at = a.select(key, axis, "ord", "along", "across", F.explode(F.array(*[F.lit(float(d)) for d in params.SEED_OFFSETS])).alias("d"))
    at = at.withColumn("a", F.floor(F.col("along") + F.col("d")).cast("int")).join(runs.select(key, axis, "a", "lo", "hi", F.col("width").alias("w")).hint("merge"), [key, axis, "a"])
    beside = at.where(f"across >= lo and across < hi + 1 and w between {params.WIDTH_MIN} and {params.WIDTH_OPEN}")
    widths = beside.groupBy(key, axis, "ord").agg(F.expr("array_sort(collect_list(w))[cast(count(*) div 2 as int)]").alias("w"))  # as many as there are offsets, at most
    lines = runs.select(key, F.when(F.col(axis) == "x", "y").otherwise("x").alias(axis), F.col("a").alias("line"), F.col("lo").alias("from"), F.col("hi").alias("to"))
    near = f"along > `from` - {params.PIECE_NEAR} and along < `to` + 1 + {params.PIECE_NEAR}"
    met = a.withColumn("line", F.floor("across").cast("int")).join(lines.hint("merge"), [key, axis, "line"]).where(near)
    own = met.groupBy(key, axis, "ord").agg(F.min(F.struct("from", "to")).alias("m")).select(key, axis, "ord", "m.from", "m.to")
    under = a.join(own, [key, axis, "ord"]).where(f"`to` - `from` + 1 >= {params.LENGTH_MIN}")
    grown = under.join(widths, [key, axis, "ord"])
    first = grown.groupBy(key, "name").agg(F.min("ord").alias("ord"))
    rows = grown.join(first, [key, "name", "ord"], "left_semi")
    return rows.select(
        key, axis, F.col("across").alias("centre"), F.least("w", F.lit(params.WIDTH_MAX)).alias("width"), (F.col("w") > params.WIDTH_MAX).alias("open"),
        F.expr("cast(`to` - `from` + 1 as long)").alias("extent"), F.array(F.struct("from", "to")).alias("lines"), "name", F.lit(False).alias("derived"),
    )


def in_bands(cells: DataFrame, found: DataFrame, margins: tuple, axis: str = "axis", key: str = "venue") -> DataFrame:
    """(key, i, j, margin): the cells whose centre lies in the band of a way (axis, centre, width, lines), as far
    beyond its width as each margin. A band is listed line by line, so cells meet the bands of their lines only."""
    bands = found.select(key, axis, "centre", "width", F.explode("lines").alias("l"), F.explode(F.array(*[F.lit(float(m)) for m in margins])).alias("margin"))
    reach = "width / 2 + margin"
    bands = bands.select(key, axis, "margin", F.col("l.from").alias("lo"), F.col("l.to").alias("hi"), F.explode(F.expr(f"sequence(cast(ceil(centre - ({reach}) - 0.5) as int), cast(floor(centre + {reach} - 0.5) as int))")).alias("line"))
    of = lambda name, line, along: cells.select(key, "i", "j", F.col(line).alias("line"), F.col(along).alias("along")).join(bands.where(F.col(axis) == name).hint("merge"), [key, "line"]).where("along between lo and hi")
    return of("y", "j", "i").union(of("x", "i", "j")).select(key, "i", "j", "margin").distinct()


def longest_ways(merged: DataFrame, axis: str = "axis", key: str = "venue") -> DataFrame:
    """The longest way of each axis that is one line, the first name of equals."""
    rows = merged.where(F.size("lines") == 1).groupBy(key, axis)
    return rows.agg(F.min(F.struct((-F.col("extent")).alias("n"), "name")).alias("m")).select(key, axis, "m.name", (-F.col("m.n")).alias("extent"))


def name_ways(found: DataFrame, arrows: DataFrame, axis: str = "axis", key: str = "venue") -> DataFrame:
    """``found`` with name and derived: the most frequent arrow (name, axis, along, across, ord) inside a way's band,
    of equals the first; unnamed ways of LENGTH_ANON are numbered by centre, shorter ones go."""
    a = arrows.select(F.col(key), F.col(axis), F.col("name").alias("arrow"), "along", "across", F.col("ord").alias("aord"))
    inside = found.join(a, [key, axis]).where("along between `from` and `to` and abs(across - centre) <= width / 2 + 1")
    votes = inside.groupBy(key, axis, "track", "arrow").agg(F.count("*").alias("n"), F.min("aord").alias("first"))
    top = votes.groupBy(key, axis, "track").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "arrow")).alias("v")).select(key, axis, "track", "v.arrow")
    named = found.join(top, [key, axis, "track"], "left").where(F.col("arrow").isNotNull() | (F.col("extent") >= params.LENGTH_ANON))
    number = F.expr(f"row_number() over (partition by {key}, {axis}, arrow is null order by centre, track)")
    label = F.format_string("%s %02d", F.when(F.col(axis) == "x", "Transversal").otherwise("Alameda"), number)
    return named.withColumns({"derived": F.col("arrow").isNull(), "name": F.coalesce("arrow", label)}).drop("arrow")


def merge_ways(named: DataFrame, axis: str = "axis", key: str = "venue") -> DataFrame:
    """One row a name and axis: mean width, total extent, whether any part is open, and all parts' lines."""
    lines = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("centre", "lines"))), lambda p: p["lines"]))
    return named.groupBy(key, "name", axis).agg(F.round(F.avg("width"), 1).alias("width"), F.sum("extent").alias("extent"), F.bool_or("open").alias("open"), F.bool_or("derived").alias("derived"), F.count("*").alias("parts"), lines.alias("lines"))
