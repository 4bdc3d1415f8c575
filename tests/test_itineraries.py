"""Stop lists: every command against what it is meant to do, and the stream against the replay of a table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from atrium.operators.itinerary import COMMANDS, FRESH, after_gap, edit, replay


def after(*commands, state=FRESH):
    for kind, value, *door in commands:
        state = edit(state, kind, value, *door)
    return list(state["stops"]), state["choice"]


FULL = [("open", 0, 9), *[("open", k) for k in range(1, 7)]]


@pytest.mark.parametrize(
    "commands, stops, choice",
    [
        ([("open", 5, 70)], [70, 5], None), ([("open", 5)], [None, 5], None), ([("define", 3), ("open", 5, 70)], [3, 5], None),
        ([("open", 1, 70), ("open", 2)], [70, 1, 2], None), ([("open", 1, 70), ("add", 0), ("open", 2)], [70, 1, None, 2], None),  # a last empty slot isn't filled by open
        ([("open", 1, 70), ("add", 0)], [70, 1, None], 2), ([("open", 1, 70), ("add", 0), ("define", 4)], [70, 1, 4], None),
        ([("open", 1), ("define", 2)], [2, 1], None), ([("open", 1, 70), ("define", 2)], [70, 1, 2], None), ([("choose", 1), ("define", 4)], [None, 4], None),
        ([("choose", 1)], [None, None], 1), ([("choose", 1), ("choose", 1)], [None, None], None), ([("choose", 3)], [None, None], 1),
        (FULL, [9, 0, 1, 2, 3, 4, 5, 6], None), ([*FULL, ("open", 88)], [9, 0, 1, 2, 3, 4, 5, 88], None), ([*FULL, ("add", 0)], [9, 0, 1, 2, 3, 4, 5, 6], None),
        ([("open", 1, 7), ("remove", 0)], [None, 1], None), ([("open", 1, 7), ("open", 2), ("remove", 1)], [7, 2], None), ([("open", 1, 7), ("add", 0), ("remove", 0)], [1, None], None),
        ([("open", 1, 7), ("add", 0), ("choose", 0), ("remove", 1)], [7, None], 0), ([("open", 1, 7), ("open", 2), ("move", 2)], [7, 2, 1], None), ([("open", 1, 7), ("move", 0)], [7, 1], None),
        ([("open", 1, 7), ("open", 2), ("later", 0)], [1, 7, 2], None), ([("choose", 0), ("later", 1)], [None, None], 0), ([("open", 1, 7), ("reverse", 0)], [1, 7], None), ([("choose", 1), ("close", 0)], [None, None], None),
    ],
)
def test_commands(commands, stops, choice):
    assert after(*commands) == (stops, choice)


def test_a_visitor_who_comes_back_starts_where_the_last_list_did():
    state = after_gap(edit(FRESH, "open", 5, 70))
    assert after(("open", 8, 71), state=state) == ([70, 8], None)
    assert after(("reverse", 0), ("open", 8, 71), state=state) == ([71, 8], None)  # the list that was shown last had no origin
    with pytest.raises(ValueError):
        edit(FRESH, "unknown", 1)


def drawn(n=900, users=7, seed=3):
    rng, at, rows = random.Random(seed), dt.datetime(2024, 5, 1, 8), []
    kinds = ["open", "define", "add", "choose", "remove", "move", "later", "reverse", "close"]
    for k in range(n):
        at += dt.timedelta(seconds=rng.choice([0, 1, 5, 40]), milliseconds=rng.randrange(1000))
        at += dt.timedelta(hours=2) if rng.random() < 0.01 else dt.timedelta()
        rows.append((rng.choice([*range(users), 0, 0, 0]), at, k, rng.choice(kinds), rng.randrange(90), rng.choice([None, 500])))
    return rows


def test_replay_is_a_fold_and_has_edges(spark):
    rows = drawn() + [(None, dt.datetime(2024, 5, 1), 5000, "open", 1, None)]
    got = {r["user_id"]: (r["edits"], r["stops"], r["choice"]) for r in replay(spark.createDataFrame(rows, COMMANDS).repartition(6)).collect()}
    want = {}
    for user in {r[0] for r in rows} - {None}:
        state, last = FRESH, None
        own = sorted((r for r in rows if r[0] == user), key=lambda r: (r[1], r[2]))
        for _, at, _, kind, value, door in own:
            state = edit(after_gap(state) if last and (at - last).total_seconds() > 1800 else state, kind, value, door)
            last = at
        want[user] = (len(own), list(state["stops"]), state["choice"])
    assert got == want
    assert replay(spark.createDataFrame([], COMMANDS)).count() == 0


@pytest.mark.parametrize("order", ["sorted", "shuffled"])
def test_the_stream_equals_the_replay(spark, tmp_path, order):
    from atrium.streaming.commands import STATE_STORE, live_itineraries

    rows = drawn(300)
    batches = [rows[k : k + 60] for k in range(0, len(rows), 60)]
    for n, batch in enumerate(batches):
        if order == "shuffled":
            random.Random(n).shuffle(batch)
        spark.createDataFrame(batch, COMMANDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    flush = (99, rows[-1][1] + dt.timedelta(days=1), 10**6, "close", 0, None)
    spark.createDataFrame([flush], COMMANDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set(*STATE_STORE)
    try:
        stream = spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = live_itineraries(stream, late="1 second").writeStream.outputMode("update").format("memory").queryName(f"lists_{order}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        live = {}
        for r in spark.table(f"lists_{order}").collect():
            live[r["user_id"]] = max(live.get(r["user_id"], (0,)), (r["edits"], r["stops"], r["choice"]), key=lambda x: x[0])
    finally:
        spark.conf.unset(STATE_STORE[0])
    batch = {r["user_id"]: (r["edits"], r["stops"], r["choice"]) for r in replay(spark.createDataFrame(rows, COMMANDS)).collect()}
    assert {u: x for u, x in live.items() if u != 99} == batch


def test_two_opt_scans_as_one_itinerary_would(spark):
    """Against a plain pass, with several thousand itineraries in arrays at once; one group an itinerary took a second a thousand."""
    from atrium.operators.itinerary import gathered, optimise, two_opt

    rng = random.Random(8)
    lists = {k: [(rng.randrange(140), rng.randrange(97)) for _ in range(rng.randrange(2, 9))] for k in range(3000)}
    stops = spark.createDataFrame([(k, n + 1, float(x), float(y)) for k, places in lists.items() for n, (x, y) in enumerate(places)], "itin long, pos int, x double, y double")

    def plain(places):
        cost = lambda o: sum(((places[p][0] - places[q][0]) ** 2 + (places[p][1] - places[q][1]) ** 2) ** 0.5 for p, q in zip(o, o[1:]))
        base, better = list(range(len(places))), True
        while better:
            better = False
            for i in range(1, len(base) - 2):
                for j in range(i + 1, len(base) - 1):
                    other = [*base[:i], *base[i : j + 1][::-1], *base[j + 1 :]]
                    if cost(other) < cost(base) - 1e-9:
                        base, better = other, True
        return [n + 1 for n in base], cost(base), cost(range(len(places)))

    found = two_opt(stops)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString() and gathered(stops).count() == len(lists)
    got = {r["itin"]: r for r in found.collect()}
    for k, places in lists.items():
        route, metres, before = plain(places)
        assert got[k]["route"] == route and abs(got[k]["metres"] - metres) < 1e-6 and abs(got[k]["before"] - before) < 1e-6
    blank = stops.withColumn("x", F.when(F.expr("itin % 7 <> 0 or pos <> 2"), F.col("x")))
    assert {r["itin"] for r in optimise(blank).select("itin").collect()} == {k for k, p in lists.items() if len(p) >= 4 and k % 7}


def test_routed_legs_hold_both_ways(spark):
    """A pair of stops is one leg, shared by all itineraries that have it; both directions cost the same."""
    from atrium.operators import itinerary

    cells = spark.range(40 * 30).selectExpr("0L as venue", "cast(id % 40 as int) as i", "cast(id div 40 as int) as j", "id % 40 <> 20 or id div 40 = 3 as free")
    places = [(3, 3), (30, 4), (5, 20), (35, 25), (20, 9)]
    stops = spark.createDataFrame([(0, itin, pos, *map(float, p), *p) for itin in range(50) for pos, p in enumerate(places[: 4 + itin % 2], 1)], "venue long, itin long, pos int, x double, y double, i int, j int")
    legs, matrix = (f(stops, cells, 40, 30) for f in (itinerary.routed_legs, itinerary.routed_matrix))
    half, whole = ({(r["itin"], r["a"], r["b"]): r["d"] for r in rows.collect()} for rows in (legs, matrix))
    assert len(half) == 25 * 6 + 25 * 10 and half[1, 1, 5] == float("inf") and 27 < half[0, 1, 2] < 29
    assert whole == {**half, **{(n, b, a): d for (n, a, b), d in half.items()}}
    orders = [{r["itin"]: (r["route"], r["metres"], r["before"], r["accepted"]) for r in rows.collect()} for rows in (itinerary.optimise(stops, legs, both_ways=True), itinerary.optimise(stops, matrix))]
    assert orders[0] == orders[1] and orders[0][0][0] == [1, 3, 2, 4] and len(orders[0]) == 50
