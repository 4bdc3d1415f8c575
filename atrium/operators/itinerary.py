"""Itineraries: legs, totals, best orders and edits."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium import params
from atrium.functions.text import letter

from .routing import routes

MIDDLE = params.EXHAUSTIVE_UPTO - 1


def with_roles(stops: DataFrame) -> DataFrame:
    """``stops`` (itin, pos) with role and letter by position: origin, stops between, destination."""
    rows = stops.selectExpr("*", "row_number() over (partition by itin order by pos) - 1 as nth", "count(*) over (partition by itin) as n")
    role = F.when(F.col("nth") == 0, "origem").when(F.col("nth") == F.col("n") - 1, "destino").otherwise("parada")
    return rows.withColumns({"role": role, "letter": letter("nth")}).drop("nth", "n")


def leg_pairs(stops: DataFrame) -> DataFrame:
    """(itin, pos, x, y, tx, ty): each stop with the next; nulls where either end is missing."""
    at = "over (partition by itin order by pos)"
    rows = stops.selectExpr("itin", "pos", "x", "y", f"lead(x) {at} as tx", f"lead(y) {at} as ty", f"lead(pos) {at} as next").where("next is not null")
    whole = "x is not null and tx is not null"
    return rows.selectExpr("itin", "pos", *[f"case when {whole} then {c} end as {c}" for c in ("x", "y", "tx", "ty")])


def totals(legs: DataFrame) -> DataFrame:
    """(itin, legs, metres, minutes) of legs (itin, metres); blank if any leg is missing."""
    rows = legs.groupBy("itin").agg(F.count("*").alias("legs"), F.sum("metres").alias("m"), F.bool_and(F.col("metres").isNotNull()).alias("whole"))
    metres = F.when(F.col("whole"), F.col("m"))
    minutes = F.when(F.col("whole"), F.greatest(F.lit(1), F.floor(metres / params.M_PER_MIN + 0.5)))
    return rows.select("itin", "legs", metres.alias("metres"), minutes.alias("minutes"))


def gathered(stops: DataFrame, matrix: DataFrame | None = None, both_ways: bool = False) -> DataFrame:
    """(itin, n, pos, x, y): one row an itinerary, its stops in order as arrays; n counts all, of more than an
    itinerary holds those up to place MAX_STOPS stay.

    With ``matrix`` (itin, a, b, d), distances to use instead of straight lines, also its rows as legs; ``both_ways``: each holds
    from b to a too.
    """
    own = stops.groupBy("itin").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("s")).withColumn("n", F.size("s"))
    own = own.withColumn("s", F.expr(f"if(n <= {MIDDLE + 2}, s, filter(s, p -> p.pos <= {params.MAX_STOPS}))"))
    rows = own.select("itin", "n", *[F.col(f"s.{c}").alias(c) for c in ("pos", "x", "y")])
    if matrix is None:
        return rows
    legs = matrix.groupBy("itin").agg(F.collect_list(F.struct("a", "b", "d")).alias("l"))
    legs = legs.select("itin", *[(F.concat(f"l.{p}", f"l.{q}") if both_ways else F.col(f"l.{p}")).alias(p) for p, q in (("a", "b"), ("b", "a"), ("d", "d"))])
    return rows.join(legs.hint("merge"), "itin")


def costs(part: pd.DataFrame) -> np.ndarray:
    """d[itinerary, a, b] of gathered itineraries with the same number of stops, by their place in the list; not a number
    where a stop isn't filled in, infinite where no leg is given."""
    if "d" not in part:
        x, y = (np.array(part[c].tolist(), dtype=float) for c in "xy")
        return np.hypot(x[:, None, :] - x[:, :, None], y[:, None, :] - y[:, :, None])
    pos = np.array(part["pos"].tolist())
    a, b, d = (np.concatenate(part[c].to_list()) for c in "abd")
    of = np.repeat(np.arange(len(part)), part["d"].map(len))
    a, b = a[:, None] == pos[of], b[:, None] == pos[of]
    there = a.any(axis=1) & b.any(axis=1)
    out = np.full((len(part), pos.shape[1], pos.shape[1]), np.inf)
    out[of[there], a[there].argmax(axis=1), b[there].argmax(axis=1)] = d[there].astype(float)
    return out


def measured(d: np.ndarray, route: np.ndarray) -> np.ndarray:
    """Length of each itinerary's route (places, the last axis), leg after leg."""
    at = np.arange(len(d)).reshape(-1, *[1] * (route.ndim - 1))
    return d[at, route[..., :-1], route[..., 1:]].sum(axis=-1)


def permuted(d: np.ndarray) -> np.ndarray:
    """Routes by trying all orders of the stops between the ends: the first of equals."""
    n = d.shape[1]
    orders = ORDERS[n - 2]
    paths = np.concatenate([np.zeros((len(orders), 1), dtype=np.int64), orders, np.full((len(orders), 1), n - 1)], axis=1)
    return paths[d[:, paths[:, :-1], paths[:, 1:]].sum(axis=2).argmin(axis=1)]


def reversed_while_better(d: np.ndarray) -> np.ndarray:
    """Routes by first-improvement 2-opt: every itinerary scans the same reversals, so each is tried on all at once and
    taken where it gains over 1e-9, until a scan finds none."""
    n = d.shape[1]
    route = np.tile(np.arange(n), (len(d), 1))
    left = np.arange(len(d))
    while len(left):
        base, own, better = route[left], d[left], np.zeros(len(left), dtype=bool)
        now = measured(own, base)
        for i in range(1, n - 2):
            for j in range(i + 1, n - 1):
                other = base.copy()
                other[:, i : j + 1] = base[:, i : j + 1][:, ::-1]
                then = measured(own, other)
                gains = then < now - 1e-9
                base[gains], now[gains] = other[gains], then[gains]
                better |= gains
        route[left] = base
        left = left[better]
    return route


def ordered(rows: DataFrame, few, many) -> DataFrame:
    """(itin, route, metres, before) of gathered ``rows``: ``few`` finds the routes of itineraries of up to MIDDLE + 2 stops,
    ``many`` those of more, some itineraries of one size at a time."""

    def solve(batches):
        for frame in batches:
            out = []
            for (n, size), same in frame.groupby([frame["n"], frame["pos"].map(len)]):
                for at in range(0, len(same), 256):
                    part = same.iloc[at : at + 256]
                    d = costs(part)
                    route = (few if n <= MIDDLE + 2 else many)(d)
                    pos = np.take_along_axis(np.array(part["pos"].tolist()), route, axis=1)
                    out.append(pd.DataFrame({"itin": part["itin"].to_numpy(), "route": list(pos), "metres": measured(d, route), "before": measured(d, np.tile(np.arange(size), (len(d), 1)))}))
            if out:
                yield pd.concat(out)

    return rows.mapInPandas(solve, "itin long, route array<int>, metres double, before double")


def routed_legs(stops: DataFrame, cells: DataFrame, width: int, height: int, step: float = 1.0, key: str = "venue") -> DataFrame:
    """(itin, a, b, d), a < b, for all pairs of stops (key, itin, pos, i, j) by the metres of their route, one
    way for both directions; infinite where there is none. An itinerary's at most MAX_STOPS stops meet in one row."""
    own = stops.where(F.col("pos") <= params.MAX_STOPS).groupBy(key, "itin").agg(F.array_sort(F.collect_list(F.struct("pos", "i", "j"))).alias("s"))
    pairs = own.select(key, "itin", F.explode(F.expr("flatten(transform(s, (p, n) -> transform(slice(s, n + 2, size(s)), q -> struct(p, q))))")).alias("l"))
    ends = pairs.selectExpr(key, "itin", "l.p.pos as a", "l.q.pos as b", "l.p.i as ai", "l.p.j as aj", "l.q.i as bi", "l.q.j as bj")
    return routes(ends, cells, width, height, step, key).select("itin", "a", "b", F.coalesce("metres", F.lit(float("inf"))).alias("d"))


def routed_matrix(stops: DataFrame, cells: DataFrame, width: int, height: int, step: float = 1.0, key: str = "venue") -> DataFrame:
    """routed_legs in both directions."""
    both = F.explode(F.expr("array(struct(a, b), struct(b as a, a as b))"))
    return routed_legs(stops, cells, width, height, step, key).select("itin", "d", both.alias("l")).select("itin", "l.a", "l.b", "d")


#: Orders of the stops between the ends, in lexicographic order, by their number.
ORDERS = {n: np.array(list(itertools.permutations(range(1, n + 1))), dtype=np.int64).reshape(math.factorial(n), n) for n in range(MIDDLE + 1)}


def best_order(stops: DataFrame, matrix: DataFrame | None = None) -> DataFrame:
    """(itin, route, metres): the cheapest order with both ends fixed; of equals the first in lexicographic order.

    ``matrix`` (itin, a, b, d): distances to use, else straight lines. An itinerary's at most MAX_STOPS
    stops are one row; its permutations are scored as arrays, some itineraries at a time.
    """
    return ordered(gathered(stops, matrix).where(f"n between 2 and {MIDDLE + 2}"), permuted, permuted).drop("before")


def two_opt(stops: DataFrame, matrix: DataFrame | None = None) -> DataFrame:
    """(itin, route, metres, before) by first-improvement 2-opt with both ends fixed: reversals that gain over
    1e-9 are taken while scanning, on arrays of itineraries of the same number of stops."""
    return ordered(gathered(stops, matrix).where("size(pos) >= 2"), reversed_while_better, reversed_while_better)


def optimise(stops: DataFrame, matrix: DataFrame | None = None, both_ways: bool = False) -> DataFrame:
    """(itin, route, metres, before, accepted): all orders are tried where the stops between the ends are few
    enough, 2-opt improves longer ones; a change needs four stops, all filled in, and a gain."""
    whole = gathered(stops, matrix, both_ways).where("n >= 4 and size(pos) >= 2 and forall(x, v -> v is not null)")
    return accepted(ordered(whole, permuted, reversed_while_better))


def accepted(rows: DataFrame, gain: float = params.ACCEPT_GAIN) -> DataFrame:
    """``rows`` (route, metres, before) with accepted: at least four stops and more than ``gain`` saved."""
    return rows.withColumn("accepted", (F.size("route") >= 4) & (F.col("before") - F.col("metres") > gain) & (F.col("metres") < float("inf")))


def accept(current: DataFrame, found: DataFrame, gain: float = params.ACCEPT_GAIN) -> DataFrame:
    """``found`` (itin, route, metres) with accepted: at least four stops and more than ``gain`` saved."""
    rows = found.join(current.select("itin", F.col("metres").alias("before")), "itin")
    return rows.withColumn("accepted", (F.size("route") >= 4) & (F.col("before") - F.col("metres") > gain) & (F.col("metres") < float("inf")))


#: A fresh list: two slots, none chosen, closed. ``saved`` is the first slot of the list as it was last shown.
FRESH = {"stops": (None, None), "choice": None, "shown": False, "saved": None}
COMMANDS = "user_id long, ts timestamp, event_id long, kind string, value long, door long"


def edit(state: dict, kind: str, value: int, door: int | None = None) -> dict:
    """The state of an itinerary after a command; ``value`` is a place or, for a slot, taken modulo their number.

    open: a list that is shown with two places takes the place as its new last stop; one of two slots with
    no destination takes it as destination and, without an origin, the saved origin or else ``door``; any other takes it as
    last stop. define: fills the chosen slot, or the first empty one, or else becomes the last stop. add: an
    empty slot at the end, which is chosen, if there are fewer than MAX_STOPS. choose: a slot, which is let
    go if it was chosen. remove: takes a slot out, or empties it where there are two. move and later: swap a
    slot with the one before or after it. reverse. close: hides the list. A last stop replaces the one before
    if the list is full.
    """
    stops, choice, shown = list(state["stops"]), state["choice"], state["shown"]
    at = value % len(stops)

    def as_last() -> None:
        if len(stops) >= params.MAX_STOPS:
            stops.pop()
        stops.append(value)

    if kind == "close":
        return {**state, "choice": None, "shown": False}
    if kind == "open":
        if len(stops) == 2 and stops[1] is None:
            stops[:] = [stops[0] if stops[0] is not None else state["saved"] if state["saved"] is not None else door, value]
        else:
            as_last()
        choice, shown = None, True
    elif kind == "define":
        slot = choice if choice is not None else next((k for k, s in enumerate(stops) if s is None), None)
        if slot is None:
            as_last()
        else:
            stops[slot] = value
        choice, shown = None, True
    elif kind == "add":
        if len(stops) >= params.MAX_STOPS:
            return state
        stops.append(None)
        choice = len(stops) - 1
    elif kind == "choose":
        choice = None if choice == at else at
    elif kind == "remove":
        if len(stops) > 2:
            del stops[at]
        else:
            stops[at] = None
        choice = None if choice == at or choice is not None and choice >= len(stops) else choice
    elif kind in ("move", "later"):
        to = at + (1 if kind == "later" else -1)
        if not 0 <= to < len(stops):
            return state
        stops[at], stops[to] = stops[to], stops[at]
        choice = None
    elif kind == "reverse":
        stops.reverse()
        choice = None
    else:
        raise ValueError(f"unknown command {kind!r}")
    return {"stops": tuple(stops), "choice": choice, "shown": shown, "saved": stops[0]}


def after_gap(state: dict) -> dict:
    """The state of a visitor who comes back after a pause: a fresh list, but the saved origin is known."""
    return {**FRESH, "saved": state["saved"]}


def replay(commands: DataFrame, idle_s: float = params.IDLE_S) -> DataFrame:
    """(user_id, edits, stops, choice): each user's commands (COMMANDS) folded in order of (ts, event_id) to the final list.

    After a pause of more than ``idle_s`` seconds a user starts afresh, with the saved origin. Users are
    dealt by hash and their commands sorted on disk; a task folds them as a stream, with one user's few
    stops as its state, so a user of any number of commands fits. ``door`` is the origin that a place has by default.
    """

    def fold(batches):
        user, state, edits, last = None, FRESH, 0, 0.0
        for frame in batches:
            out = []
            for who, at, kind, value, door in zip(frame["user_id"].tolist(), frame["at"].tolist(), frame["kind"].tolist(), frame["value"].tolist(), frame["door"].tolist()):
                if who != user:
                    if edits:
                        out.append((user, edits, state["stops"], state["choice"]))
                    user, state, edits, last = who, FRESH, 0, at
                state = edit(after_gap(state) if at - last > idle_s else state, kind, int(value), None if pd.isna(door) else int(door))
                edits, last = edits + 1, at
            yield pd.DataFrame(out, columns=["user_id", "edits", "stops", "choice"])
        if edits:
            yield pd.DataFrame([(user, edits, state["stops"], state["choice"])], columns=["user_id", "edits", "stops", "choice"])

    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ordered = commands.where("user_id is not null").withColumn("at", at).repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return ordered.select("user_id", "at", "kind", "value", "door").mapInPandas(fold, "user_id long, edits long, stops array<long>, choice int")
