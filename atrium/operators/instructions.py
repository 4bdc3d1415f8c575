"""Turn-by-turn instructions: legs to ways, merging, turns, sentences; all of it column expressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium import params
from atrium.functions import geometry as geo

from .labels import CELL, cells_of_box


def ways_in_cells(ways: DataFrame, to_cell, keep: tuple = ()) -> DataFrame:
    """One row (``keep``, ord, name, derived, ax, ay, bx, by, width) for each line of each way, its ends only, in cells.

    ``ways`` has lines: arrays of points; a way without a width gets the default.
    """
    rows = ways.select(*keep, "ord", "name", "derived", F.coalesce("width", F.lit(params.WAY_DEFAULT_WIDTH)).alias("width"), F.explode("lines").alias("l"))
    rows = rows.withColumns({"p": F.col("l")[0], "q": F.element_at("l", -1)})
    (ax, ay), (bx, by) = to_cell("p.x", "p.y"), to_cell("q.x", "q.y")
    return rows.select(*keep, "ord", "name", "derived", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), "width")


def with_coverage(pairs: DataFrame, step: float = 1.0) -> DataFrame:
    """``pairs`` of legs and ways with cov: the share of a leg's WAY_SAMPLES + 1 samples (pi, pj) to (qi, qj) within half
    the way's width plus the slack.

    The place along the way is linear in the sample, so its start and its step are columns of their own;
    the terms of the sum are plain arithmetic on them, which is compiled; a distance is a root, as in SQL: hypot is
    long work in Java and rounds otherwise.
    """
    along = lambda x, y: f"coalesce((({x}) * (bx - ax) + ({y}) * (`by` - ay)) / nullif((bx - ax) * (bx - ax) + (`by` - ay) * (`by` - ay), 0D), 0D)"
    motion = {"_t": along("pi - ax", "pj - ay"), "_dt": along("qi - pi", "qj - pj"), "_wx": "bx - ax", "_wy": "`by` - ay", "_x": "pi - ax", "_y": "pj - ay", "_dx": "qi - pi", "_dy": "qj - pj", "_r": f"(width / 2 + {params.WAY_SLACK}D) / {step}D"}
    hits = []
    for s in range(params.WAY_SAMPLES + 1):
        k = f"{s / params.WAY_SAMPLES}D"
        t = f"greatest(0D, least(1D, _t + _dt * {k}))"
        x, y = f"(_x + _dx * {k} - {t} * _wx)", f"(_y + _dy * {k} - {t} * _wy)"
        hits.append(f"if(sqrt({x} * {x} + {y} * {y}) <= _r, 1, 0)")
    rows = pairs.withColumns({c: F.expr(e) for c, e in motion.items()})
    return rows.withColumn("cov", F.expr(f"round(({' + '.join(hits)}) / {params.WAY_SAMPLES + 1}D, 9)")).drop(*motion)


def leg_ways(legs: DataFrame, ways: DataFrame, step: float = 1.0, key: str = "venue") -> DataFrame:
    """``legs`` (key, leg, pi, pj, qi, qj) with the way that explains each, or nulls.

    The way with the best coverage, at least WAY_COVERAGE; of equals the wider, then the first. A leg that a
    way explains misses it with a few samples at most, so of one sample more in its middle one hits: only the
    cells of those meet the bands of ways.
    """
    samples = params.WAY_SAMPLES + 1
    most_missed = samples - math.ceil(samples * params.WAY_COVERAGE - 1e-9)
    first = (samples - most_missed - 1) // 2
    middle = f"sequence({first}, {first + most_missed})"
    reach = (F.col("width") / 2 + params.WAY_SLACK) / step
    boxed = ways.withColumns({"x0": F.least("ax", "bx") - reach, "y0": F.least("ay", "by") - reach, "x1": F.greatest("ax", "bx") + reach, "y1": F.greatest("ay", "by") + reach})
    boxed = boxed.select("*", F.explode(cells_of_box("x0", "y0", "x1", "y1")).alias("cell")).drop("x0", "y0", "x1", "y1")
    at = lambda p, q: f"cast(floor(({p} + ({q} - {p}) * k / {params.WAY_SAMPLES}D) / {CELL}) as int)"
    own = legs.select(key, "leg", "pi", "pj", "qi", "qj", F.explode(F.expr(f"array_distinct(transform({middle}, k -> struct({at('pi', 'qi')} as i, {at('pj', 'qj')} as j)))")).alias("cell"))
    near = with_coverage(own.join(boxed, [key, "cell"]), step)
    # The threshold stands inside the aggregate: as a filter of its own it would have the coverage worked out twice.
    good = F.when(F.col("cov") >= params.WAY_COVERAGE, F.struct((-F.col("cov")).alias("c"), (-F.col("width")).alias("w"), "ord", "name", "derived"))
    best = near.groupBy(key, "leg").agg(F.min(good).alias("m")).where("m is not null")
    return legs.join(best.select(key, "leg", F.col("m.name").alias("way"), F.col("m.derived").alias("derived"), (-F.col("m.c")).alias("coverage")), [key, "leg"], "left")


def turns(legs: DataFrame, handedness: int = 1) -> DataFrame:
    """``legs`` (route, seq, dx, dy, way) with turn: partida, frente, esquerda or direita, and changed: the way did."""
    at = "over (partition by route order by seq)"
    rows = legs.selectExpr("*", f"lag(dx) {at} as px", f"lag(dy) {at} as py", f"lag(way) {at} as before")
    angle = geo.angle_between("px", "py", "dx", "dy")
    turn = F.when(F.col("px").isNull(), "partida").when(angle >= params.TURN_MIN, geo.turn_side("px", "py", "dx", "dy", F.lit(handedness))).otherwise("frente")
    rows = rows.withColumns({"turn": turn, "angle": angle})
    return rows.withColumn("changed", (F.col("turn") == "frente") & F.col("way").isNotNull() & ~F.col("way").eqNullSafe(F.col("before"))).drop("px", "py", "before")


def one_way_runs(legs: DataFrame) -> DataFrame:
    """(route, run, way, derived, m, dx, dy, label): neighbouring legs on one named way as one.

    Its direction is that of the last leg that is longer than all before it in the run together.
    """
    order = "partition by route order by seq"
    rows = legs.selectExpr("*", f"case when way is not null and way = lag(way) over ({order}) then 0 else 1 end as opens").selectExpr("*", f"sum(opens) over ({order}) as run")
    rows = rows.selectExpr("*", "coalesce(sum(metres) over (partition by route, run order by seq rows between unbounded preceding and 1 preceding), -1D) as before")
    turned = F.when(F.col("metres") > F.col("before"), F.struct("seq", "dx", "dy"))
    per = rows.groupBy("route", "run").agg(F.first("way").alias("way"), F.bool_or(F.coalesce("derived", F.lit(False))).alias("derived"), F.sum("metres").alias("m"), F.max(turned).alias("d"), F.max("label").alias("label"))
    return per.select("route", "run", "way", "derived", "m", "d.dx", "d.dy", "label")


def without_short(runs: Column) -> Column:
    """A route's runs (array of run, way, derived, m, dx, dy) without short unnamed ones: such a run's length goes
    to the next one, which may be long enough then; at the route's end, to the one before, if there is any."""
    kept = "array<struct<way:string,derived:boolean,m:double,dx:double,dy:double>>"
    start = F.struct(F.expr(f"cast(array() as {kept})").alias("out"), F.lit(0.0).alias("carry"), F.lit(0).alias("n"))

    def step(state: Column, run: Column) -> Column:
        m, n, out = run["m"] + state["carry"], state["n"] + 1, state["out"]
        short = run["way"].isNull() & (m < params.SHORT_M)
        row = lambda r, length: F.struct(r["way"].alias("way"), r["derived"].alias("derived"), length.alias("m"), r["dx"].alias("dx"), r["dy"].alias("dy"))
        last = F.get(out, F.size(out) - 1)
        longer = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(row(last, last["m"] + m)))
        waits = short & (n < F.size(runs))
        grown = F.when(waits, out).when(short & (F.size(out) > 0), longer).otherwise(F.concat(out, F.array(row(run, m))))
        return F.struct(grown.alias("out"), F.when(waits, m).otherwise(0.0).alias("carry"), n.alias("n"))

    return F.aggregate(runs, start, step, lambda s: s["out"])


def rounded(m: Column) -> Column:
    """Metres as they are spoken: whole fives, at least five."""
    return F.greatest(F.lit(5), F.floor(m / 5 + 0.5) * 5)


def arrival(label: Column) -> Column:
    """The sentence of the last step, with the route's label if it has one."""
    return F.when(label.isNotNull(), F.replace(F.lit(params.TEXT["arrive"]), F.lit("{label}"), label)).otherwise(params.TEXT["arrive_plain"])


def instructions(legs: DataFrame, handedness: int = 1) -> DataFrame:
    """(route, seq, turn, way, derived, metres, text) of legs (route, seq, dx, dy, metres, way, derived, label).

    Legs on one way are merged, short unnamed ones absorbed; each step is told by its turn against the
    one before, and the arrival comes last, with the route's label. A route without legs has no steps.
    """
    runs = one_way_runs(legs).groupBy("route").agg(F.array_sort(F.collect_list(F.struct("run", "way", "derived", "m", "dx", "dy"))).alias("runs"), F.max("label").alias("label"))
    told = runs.withColumn("steps", without_short(F.col("runs"))).select("route", "label", F.posexplode("steps").alias("seq", "s")).select("route", "label", "seq", "s.*")
    steps = turns(told, handedness).withColumn("say", rounded(F.col("m")).cast("string"))
    text, named = params.TEXT, F.col("way").isNotNull()
    pick = lambda way, plain: F.when(named, text[way]).otherwise(text[plain])
    line = (
        F.when(F.col("turn") == "partida", pick("start_way", "start"))
        .when(F.col("turn") != "frente", pick("turn_way", "turn"))
        .when(F.col("changed"), text["change"])
        .otherwise(pick("go_way", "go"))
    )
    for slot, value in (("{m}", F.col("say")), ("{side}", F.col("turn")), ("{way}", F.coalesce("way", F.lit("")))):
        line = F.replace(line, F.lit(slot), value)
    steps = steps.select("route", "label", F.col("seq").cast("int").alias("seq"), "turn", "way", "derived", F.col("m").alias("metres"), line.alias("text"))
    end = steps.groupBy("route").agg((F.max("seq") + 1).alias("seq"), F.max("label").alias("label"))
    end = end.select("route", "label", "seq", F.lit("chegada").alias("turn"), F.lit(None).cast("string").alias("way"), F.lit(False).alias("derived"), F.lit(0.0).alias("metres"), arrival(F.col("label")).alias("text"))
    return steps.unionByName(end).drop("label")
