"""Common table expressions for the DuckDB side: the same scenario rows, parsed independently with unnest, lead and CASE."""

from __future__ import annotations

from ..sources import bridge

SEATS = "('UTG', 'HJ', 'CO', 'BTN', 'SB', 'BB')"
RAW = f"raw as ({bridge.sql(bridge.SCENARIOS, True)})"
#: Tokens by place, then events: a seat with a size or a verb behind it.
EVENTS = f"""
lists as (select split, source_index, hero_pos, list_filter(string_split(coalesce(prev_line, ''), '/'), lambda x: x <> '') as l from raw),
toks as (select split, source_index, hero_pos, i, l[i] as t, l[i + 1] as a, l[i + 2] as b from (select *, unnest(range(1, len(l) + 1)) as i from lists)),
ev0 as (
  select split, source_index, hero_pos, i, t as position,
    case when regexp_full_match(a, '[0-9]+([.][0-9]+)?bb') then 'raise' when lower(a) in ('fold', 'check', 'call', 'allin', 'raise', 'post') then lower(a) when lower(a) = 'bet' then 'raise' end as action,
    case when regexp_full_match(a, '[0-9]+([.][0-9]+)?bb') then cast(replace(a, 'bb', '') as double) when lower(a) = 'allin' and regexp_full_match(b, '[0-9]+([.][0-9]+)?bb') then cast(replace(b, 'bb', '') as double) end as amount
  from toks where t in {SEATS}
),
ev as (select *, row_number() over (partition by split, source_index order by i) - 1 as seq from ev0 where action is not null)
"""
COUNTS = """
cnt as (
  select split, source_index, count(*) as n, count(*) filter (where action = 'raise') as n_raise, count(*) filter (where action = 'allin') as n_allin, count(*) filter (where action = 'call') as n_call,
    count(*) filter (where action = 'fold') as n_fold, max(amount) as max_bet, arg_max(amount, seq) filter (where amount is not null) as last_bet,
    arg_max(position, seq) filter (where action in ('raise', 'allin')) as aggressor, max(seq) filter (where action in ('raise', 'allin')) as last_seq
  from ev group by 1, 2
)
"""
_LABEL = "lower(trim({x}))"


def canonical(x: str) -> str:
    t = _LABEL.format(x=x)
    return f"case when {t} like 'fold%' then 'fold' when {t} like 'check%' then 'check' when {t} like 'call%' then 'call' when {t} like 'allin%' or {t} like '%all-in%' or {t} like '%all in%' then 'allin' when {t} like 'bet%' or {t} like 'raise%' or regexp_full_match({t}, '[0-9]+([.][0-9]+)?\\s*bb') then 'raise' end"


def rank(card: str) -> str:
    return f"(strpos('23456789TJQKA', substr({card}, 1, 1)) + 1)"


_A, _B = rank("substr(hero_holding, 1, 2)"), rank("substr(hero_holding, 3, 2)")
HANDS = f"""
hands0 as (select split, source_index, hero_pos, hero_holding, num_players, cast(greatest({_A}, {_B}) as int) as hi, cast(least({_A}, {_B}) as int) as lo, substr(hero_holding, 2, 1) = substr(hero_holding, 4, 1) and {_A} <> {_B} as suited from raw),
hands as (
  select *, concat(substr('23456789TJQKA', hi - 1, 1), substr('23456789TJQKA', lo - 1, 1), case when hi = lo then '' when suited then 's' else 'o' end) as hand_class,
    greatest(0, hi - lo - 1) as gap, case when suited or hi = lo then (14 - hi) * 13 + 14 - lo else (14 - lo) * 13 + 14 - hi end as class_index,
    case hi when 14 then 10.0 when 13 then 8.0 when 12 then 7.0 when 11 then 6.0 else cast(hi as double) / 2 end as top
  from hands0
),
chen as (
  select *, cast(case when hi = lo then case when hi = 5 then 6 else greatest(5.0, top * 2) end
    else top - case gap when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 4 else 5 end + case when suited then 2 else 0 end + case when gap <= 1 and hi < 12 then 1 else 0 end end as double) as chen from hands
)
"""
SITUATIONS = f"""
sit as (
  select row_number() over (order by case when r.split = 'train' then 0 else 1 end, r.source_index) as situation_id, r.split, r.source_index, r.hero_pos, h.hand_class, r.hero_holding, r.pot_size,
    h.hi = h.lo as pair, h.suited, h.lo >= 10 as broadway, r.num_players, r.num_bets, r.instruction, r.available_moves, r.prev_line,
    coalesce(c.max_bet, 0) as facing_bet, coalesce(c.n_raise, 0) + coalesce(c.n_allin, 0) = 0 as open_pot,
    case when coalesce(c.n_allin, 0) > 0 then 'allin_facing' when coalesce(c.n_raise, 0) = 0 and coalesce(c.n_call, 0) = 0 then 'unopened' when coalesce(c.n_raise, 0) = 0 then 'limped_facing'
      when c.n_raise = 1 then 'open_raise_facing' when c.n_raise = 2 then '3bet_facing' else '4bet+_facing' end as decision_type,
    trim(r.correct_decision) as raw_label, {canonical('r.correct_decision')} as canonical_label,
    case r.source_index % 13 when 2 then 3.0 when 3 then 13.1 when 6 then 24.0 when 10 then 7.5 end as label_bet
  from raw r join hands h using (split, source_index) left join cnt c using (split, source_index)
)
"""


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


BASE = with_(RAW, EVENTS, COUNTS, HANDS, SITUATIONS)
CHEN = with_(RAW, HANDS)
PRED = f"with pred as ({bridge.PREDICTIONS})\n"
DECISION = f"with dec as ({bridge.DECISIONS})\n"
