"""Queries on visitors' taps and commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium import params
from atrium.operators import itinerary
from atrium.sources import venue
from atrium.streaming.taps import session_counts

from .registry import query


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as n from events), s as (select *, sum(n) over (partition by user_id order by ts, event_id) as session from g)
select user_id, min(ts) as started, max(ts) + interval 30 minute as ended, count(*) as taps from s group by user_id, session""")
def tap_sessions(spark, sf_dir):
    """Sessions of taps with gaps under half an hour."""
    return session_counts(venue.table(spark, sf_dir, "events"))


#: Every command occurs; a place has one of ten doors by default, or none. The same text in both dialects.
_KIND = """case event_type when 'click' then case when event_id % 2 = 0 then 'open' else 'define' end when 'purchase' then 'open' when 'error' then case when event_id % 4 = 0 then 'close' else 'remove' end
  when 'signup' then case when event_id % 3 = 0 then 'reverse' else 'add' end else case event_id % 3 when 0 then 'choose' when 1 then 'move' else 'later' end end"""
_VALUE, _DOOR = "event_id % 97", "case when event_id % 97 % 7 = 0 then null else 1000 + event_id % 97 % 10 end"


def commands(spark, sf_dir):
    """Each visitor's taps as edits of a stop list."""
    return venue.table(spark, sf_dir, "events").selectExpr("user_id", "ts", "event_id", f"{_KIND} as kind", f"{_VALUE} as value", f"{_DOOR} as door")


@query(f"""with recursive c as (select user_id, row_number() over w as n, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over w > {int(params.IDLE_S)} * 1000000, false) as fresh, {_KIND} as kind, ({_VALUE})::bigint as value, ({_DOOR})::bigint as door
  from events where user_id is not null window w as (partition by user_id order by ts, event_id)),
s(user_id, n, stops, choice, saved) as (select distinct user_id, 0::bigint, [null, null]::bigint[], null::bigint, null::bigint from c
  union all
  select user_id, n, ns, case when kind in ('open', 'define', 'reverse', 'close') then null when kind = 'add' then case when k < {params.MAX_STOPS} then k else ch end when kind = 'choose' then nullif(slot0, ch)
      when kind = 'remove' then case when ch = slot0 or ch >= len(ns) then null else ch end when "to" between 0 and k - 1 then null else ch end,
    case when kind = 'close' or kind = 'add' and k >= {params.MAX_STOPS} or kind in ('move', 'later') and "to" not between 0 and k - 1 then saved else ns[1] end
  from (select *, case
      when kind = 'open' and k = 2 and st[2] is null then [coalesce(st[1], saved, door), value]
      when kind = 'define' and slot is not null then st[1:slot] || [value] || st[slot + 2:]
      when kind in ('open', 'define') then st[1:{params.MAX_STOPS - 1}] || [value]
      when kind = 'add' then case when k < {params.MAX_STOPS} then st || [null::bigint] else st end
      when kind = 'remove' then case when k > 2 then st[1:slot0] || st[slot0 + 2:] else st[1:slot0] || [null::bigint] || st[slot0 + 2:] end
      when kind in ('move', 'later') and "to" between 0 and k - 1 then st[1:least(slot0, "to")] || [st[greatest(slot0, "to") + 1], st[least(slot0, "to") + 1]] || st[greatest(slot0, "to") + 2:]
      when kind = 'reverse' then list_reverse(st) else st end as ns
    from (select *, len(st) as k, value % len(st) as slot0, value % len(st) + case when kind = 'later' then 1 else -1 end as "to", coalesce(ch, [x for x in range(len(st)) if st[x + 1] is null][1]) as slot
      from (select s.user_id, c.n, kind, value, door, saved, case when fresh then [null, null]::bigint[] else stops end as st, case when not fresh then choice end as ch from s join c on c.user_id = s.user_id and c.n = s.n + 1))))
select user_id, max(n) as edits, array_to_string([coalesce(x::varchar, '-') for x in arg_max(stops, n)], ',') as stops, arg_max(coalesce(choice, -1), n)::int as choice from s group by user_id""")
def command_replay(spark, sf_dir):
    """Each user's commands folded to the stops that remain."""
    return itinerary.replay(commands(spark, sf_dir)).select("user_id", "edits", F.array_join("stops", ",", "-").alias("stops"), F.coalesce("choice", F.lit(-1)).alias("choice"))
