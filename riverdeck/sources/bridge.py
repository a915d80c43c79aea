"""Scenario rows derived from the star-schema test tables.

One scenario for each order, one action for each of its lines, one trajectory decision for each event: only
integer arithmetic and text on keys.  The SQL runs on Spark and on DuckDB; the few words in which they differ are put in
by :func:`sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_RANK = "substr('23456789TJQKA', cast({c} % 13 as int) + 1, 1)"
_SUIT = "substr('shdc', cast(({c} - {c} % 13) / 13 as int) + 1, 1)"
_CARD = f"concat({_RANK}, {_SUIT})"
_NAME = "case cast(substr('23456789TJQKA', cast({c} % 13 as int) + 1, 1) as {text}) when '2' then 'Two' when '3' then 'Three' when '4' then 'Four' when '5' then 'Five' when '6' then 'Six' when '7' then 'Seven' when '8' then 'Eight' when '9' then 'Nine' when 'T' then 'Ten' when 'J' then 'Jack' when 'Q' then 'Queen' when 'K' then 'King' else 'Ace' end"
_OF = "case cast(({c} - {c} % 13) / 13 as int) when 0 then 'Spade' when 1 then 'Heart' when 2 then 'Diamond' else 'Club' end"


def _seat(x: str) -> str:
    return f"case cast({x} % 6 as int) when 0 then 'UTG' when 1 then 'HJ' when 2 then 'CO' when 3 then 'BTN' when 4 then 'SB' else 'BB' end"


_LINES = f"""
select l_orderkey, {{listagg}} as prev_line, count(*) as n_lines, sum(cast(l_quantity as bigint)) as qty
from (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
    concat({_seat('l_suppkey')}, '/',
      case cast(l_partkey % 5 as int) when 0 then 'fold' when 1 then 'call' when 2 then 'allin' when 3 then 'check'
      else concat(cast(cast(l_quantity as int) as {{text}}), '.5bb') end) as piece
  from lineitem
) t group by l_orderkey
"""

_KEYS = f"""
select o_orderkey, o_custkey, {_seat('o_orderkey')} as hero_pos,
  case when o_orderkey % 10 = 0 then 'test' else 'train' end as split,
  cast((7 * o_orderkey + o_custkey) % 52 as int) as c1,
  cast(((7 * o_orderkey + o_custkey) % 52 + 1 + (13 * o_orderkey + 5 * o_custkey) % 51) % 52 as int) as c2
from orders
"""

#: Both sides are as large as the orders, so neither is broadcast; the lines are already dealt by order.
SCENARIOS = f"""
select /*+ merge(l) */ split, o_orderkey as source_index, hero_pos, concat({_CARD.format(c='c1')}, {_CARD.format(c='c2')}) as hero_holding,
  prev_line, cast(2 + o_orderkey % 5 as int) as num_players, cast(o_orderkey % 4 as int) as num_bets,
  (3 + o_orderkey % 40) * 0.5E0 as pot_size,
  case cast(o_orderkey % 3 as int) when 0 then cast(null as double) when 1 then 0.0E0 else 20.0E0 + o_orderkey % 100 end as hero_stack_bb,
  case cast(o_orderkey % 5 as int) when 0 then '[''fold'', ''call'', ''raise'']' when 1 then '[''check'', ''Fold'']' when 2 then 'fold, call,' when 3 then cast(null as {{text}}) else '[''fold'', ''allin'', ''fold'']' end as available_moves,
  case cast(o_orderkey % 13 as int) when 0 then 'fold' when 1 then 'Call' when 2 then '3.0bb' when 3 then 'raise 13.1' when 4 then 'all-in' when 5 then 'check' when 6 then 'bet 24'
    when 7 then ' Fold ' when 8 then 'ALLIN' when 9 then 'wtf' when 10 then 'Raise 7.5bb' when 11 then cast(null as {{text}}) else 'going all-in' end as correct_decision,
  concat('You are playing a ', cast(2 + o_orderkey % 5 as {{text}}), '-handed game. The player positions involved in this game are UTG, HJ, ', hero_pos, '. The small blind is 0.5 chips and the big blind is 1 chips. Everyone started with ',
    cast(50 + o_orderkey % 51 as {{text}}), ' chips. In this hand, your position is ', hero_pos, ', and your holding is [',
    {_NAME.format(c='c1', text='{text}')}, ' of ', {_OF.format(c='c1')}, ' and ', {_NAME.format(c='c2', text='{text}')}, ' of ', {_OF.format(c='c2')}, ']. Before the flop, ',
    coalesce(prev_line, 'no action yet'), '. Assume that all other players that is not mentioned folded. The current pot size is ', cast(3 + o_orderkey % 40 as {{text}}), '.5 chips.') as instruction,
  case cast(o_orderkey % 4 as int) when 0 then 'flop' when 1 then 'turn' when 2 then 'river' else 'unknown' end as street,
  concat({_CARD.format(c='((c1 + 11) % 52)')}, {_CARD.format(c='((c1 + 25) % 52)')}, {_CARD.format(c='((c2 + 38) % 52)')}) as board
from ({_KEYS}) k left join ({_LINES}) l on l.l_orderkey = k.o_orderkey
"""

#: Seven different cards of each order: its two, then five more at distances that can't meet (7 is prime to 52).
SEVEN = """
select o_orderkey, cast((o_orderkey * 11 + i * (1 + 2 * (o_custkey % 25) + case when (1 + 2 * (o_custkey % 25)) % 13 = 0 then 2 else 0 end)) % 52 as int) as c, i
from orders, (select 0 as i union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6) n
"""

DECISIONS = f"""
select event_id as decision_id, user_id as hand_id, cast(event_id % 6 as int) as seat_id, {_seat('event_id')} as position,
  case event_type when 'view' then 'check' when 'signup' then 'call' when 'purchase' then 'raise' when 'error' then 'fold' else 'allin' end as action,
  case when event_type = 'purchase' then cast(event_id % 200 as double) / 8 end as amount_bb,
  (cast(event_id * 7 % 401 as double) - 200) / 8 as reward_bb, event_id % 3 = 0 as showdown,
  case cast(event_id % 4 as int) when 0 then 'preflop' when 1 then 'flop' when 2 then 'turn' else 'river' end as street, value
from events
"""

#: Three class probabilities, the true class, bets, pots and a villain label of each event.
PREDICTIONS = """
select event_id, p0, p1, p2, cast(event_id * 17 % 3 as int) as y, cast(event_id % 5 as int) - 1 as v5,
  case when event_id % 4 = 0 then -1 else cast(event_id % 2 as int) end as villain_y, (event_id * 31 % 1000) / 1000.0E0 as villain_p,
  (event_id % 60) * 0.5E0 as pot, case when event_id % 5 = 0 then 0.0E0 else (event_id % 24) * 0.25E0 end as bet
from (
  select event_id, a / (a + b + c) as p0, b / (a + b + c) as p1, c / (a + b + c) as p2
  from (select event_id, 1.0E0 + event_id * 37 % 101 as a, 1.0E0 + event_id * 53 % 103 as b, 1.0E0 + event_id * 71 % 107 as c from events) x
) y
"""


def sql(text: str, duck: bool) -> str:
    """The SQL for DuckDB or for Spark."""
    order = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
    agg = f"string_agg(piece, '/' order by {order})" if duck else f"listagg(piece, '/') within group (order by {order})"
    return text.replace("{listagg}", agg).replace("{text}", "varchar" if duck else "string")


def _views(spark: SparkSession, sf_dir: str, names: str, text: str) -> DataFrame:
    """Run SQL over tables given as DataFrames, without temporary views."""
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names.split()}
    for n in frames:
        text = text.replace(f"from {n}", f"from {{{n}}}")
    return spark.sql(text, **frames)


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, "orders lineitem", sql(SCENARIOS, False))


def seven_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, "orders", SEVEN)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, "events", DECISIONS)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, "events", PREDICTIONS)
