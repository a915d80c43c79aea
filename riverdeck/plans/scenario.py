"""Queries over scenario rows: the prompt database, its views, statistics and cookbook, and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import cards, labels, lines, prompts
from ..operators import features, metrics, promptdb, rewards
from ..sources import bridge, readers, shared
from . import duck
from .registry import query


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.scenarios(spark, sf)


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return promptdb.build(_raw(spark, sf))


def _light(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of situations that statistics need, without ids and prompt texts: nothing is shuffled for them."""
    raw = _raw(spark, sf)
    hole, ev, label = F.trim("hero_holding"), lines.events(F.col("prev_line")), F.trim("correct_decision")
    df = raw.select("split", "source_index", "hero_pos", hole.alias("hero_hole"), cards.hand_class(hole).alias("hero_hand_class"), ev.alias("events"), label.alias("raw_label"), labels.canonical(label).alias("canonical_label"), labels.bet_size(label).alias("label_bet_bb"))
    return df.withColumn("decision_type", lines.decision_type(F.col("events")))


@query(
    "prj_situation",
    duck.BASE + """select situation_id, split, source_index, instruction as prompt_text, cast(1 as bigint) as prompt_template_id, cast(2 + source_index % 5 as int) as table_size, 0.5e0 as small_blind_chips, 1.0e0 as big_blind_chips, cast(50 + source_index % 51 as double) as starting_stack_chips, hero_pos,
  case when hero_pos = 'UTG' then 'early' when hero_pos = 'HJ' then 'middle' when hero_pos in ('CO', 'BTN') then 'late' else 'blinds' end as hero_position_category,
  hero_holding as hero_hole, hand_class as hero_hand_class, cast(pair as int) as hero_is_pair, cast(suited as int) as hero_is_suited, cast(broadway as int) as hero_is_broadway,
  prev_line, num_players, num_bets, cast(3 + source_index % 40 as double) + 0.5 as pot_size_chips, pot_size as pot_bb, facing_bet as facing_bet_bb, cast(open_pot as int) as is_open_pot, decision_type, raw_label, canonical_label, cast(label_bet as double) as label_bet_bb from sit""",
)
def prj_situation(spark, sf):
    """All 27 columns, prompt texts and template numbers among them."""
    return promptdb.full(promptdb.build(_raw(spark, sf), once=True))


@query("win_situation_id", duck.BASE + "select situation_id, split, source_index from sit")
def win_situation_id(spark, sf):
    return promptdb.with_situation_id(_raw(spark, sf).select("split", "source_index")).select("situation_id", "split", "source_index")


@query("fn_parse_prev_line", duck.with_(duck.RAW, duck.EVENTS) + "select split, source_index, seq, position, action, amount from ev")
def fn_parse_prev_line(spark, sf):
    return _light(spark, sf).select("split", "source_index", F.posexplode("events").alias("seq", "e")).select("split", "source_index", F.col("seq").cast("long").alias("seq"), "e.position", "e.action", F.col("e.amount_bb").alias("amount"))


@query("win_seq_index", duck.BASE + "select situation_id, seq as seq_index, ev.position as actor_pos, action as action_type, amount as size_bb from sit join ev using (split, source_index)")
def situation_actions(spark, sf):
    return _tables(spark, sf)["situation_actions"].withColumn("seq_index", F.col("seq_index").cast("long"))


@query("win_seat_order", duck.BASE + """, seats as (select situation_id, hero_pos as position, case hero_pos when 'UTG' then 0 when 'HJ' then 1 when 'CO' then 2 when 'BTN' then 3 when 'SB' then 4 else 5 end as seat_order from sit
  union select situation_id, 'UTG', 0 from sit union select situation_id, 'HJ', 1 from sit) select situation_id, position, seat_order from seats""")
def situation_positions(spark, sf):
    return _tables(spark, sf)["situation_positions"]


@query("set_dedup_insert", duck.BASE + """, m as (select situation_id, case source_index % 5 when 0 then ['fold', 'call', 'raise'] when 1 then ['check', 'fold'] when 2 then ['fold', 'call'] when 3 then [] else ['fold', 'allin'] end as l from sit)
select situation_id, unnest(l) as move from m""")
def situation_available_moves(spark, sf):
    return _tables(spark, sf)["situation_available_moves"]


@query("join_corr_count", duck.BASE + """select situation_id, decision_type, (select count(*) from ev where ev.split = sit.split and ev.source_index = sit.source_index) as n_prev_actions,
  case source_index % 5 when 0 then 3 when 3 then 0 else 2 end as n_available_moves from sit""")
def v_situation_summary(spark, sf):
    return promptdb.summary_view(_tables(spark, sf)).select("situation_id", "decision_type", "n_prev_actions", F.col("n_available_moves").cast("int").alias("n_available_moves"))


for _name, _column in (("agg_position_action", "hero_pos"), ("agg_hand_class_action", "hero_hand_class"), ("agg_decision_type_mix", "decision_type")):
    _duck = "hand_class" if _column == "hero_hand_class" else _column
    query(_name, duck.BASE + f"select {_duck} as {_column}, canonical_label, count(*) as n from sit where canonical_label is not null group by 1, 2")(lambda spark, sf, c=_column: promptdb.matrix_view(_light(spark, sf), c))

for _name, _column in (("agg_split_counts", "split"), ("agg_decision_counts", "decision_type"), ("agg_label_counts", "canonical_label")):
    query(_name, duck.BASE + f"select {_column}, count(*) as n from sit group by 1 order by 2 desc, 1")(lambda spark, sf, c=_column: _light(spark, sf).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c))


@query("agg_table_counts", duck.BASE + """select 'situations' as name, count(*) as n from sit union all select 'situation_actions', count(*) from ev union all select 'prompt_templates', 1
union all select 'label_taxonomy', count(distinct lower(raw_label)) from sit union all select 'situation_available_moves', cast(sum(case source_index % 5 when 0 then 3 when 3 then 0 else 2 end) as bigint) from sit
union all select 'situation_positions', cast(sum(case when hero_pos in ('UTG', 'HJ') then 2 else 3 end) as bigint) from sit""")
def agg_table_counts(spark, sf):
    return promptdb.table_counts(_raw(spark, sf))


@query("agg_label_taxonomy", duck.BASE + "select lower(raw_label) as raw_label, coalesce(min(canonical_label), 'unknown') as canonical_label, cast(min(label_bet) as double) as bet_size_bb, count(*) as n_occurrences from sit where raw_label is not null group by 1")
def agg_label_taxonomy(spark, sf):
    return promptdb.taxonomy(_light(spark, sf))


@query("agg_template_dim", duck.RAW.join(["with ", ""]) + """select cast(1 as bigint) as template_id, substr(sha256(shell), 1, 16) as template_hash, 10 as n_slots from (select
 'You are playing a <N>-handed game. The player positions involved in this game are <POSITIONS>. The small blind is <SB> chips and the big blind is <BB> chips. Everyone started with <STACK> chips. In this hand, your position is <POS>, and your holding is [<HOLDING>]. Before the flop, <PREV_LINE>. Assume that all other players that is not mentioned folded. The current pot size is <POT> chips.' as shell) where exists (select 1 from raw)""")
def agg_template_dim(spark, sf):
    return _tables(spark, sf)["prompt_templates"].select("template_id", "template_hash", "n_slots")


@query("fn_parse_slots", duck.RAW.join(["with ", ""]) + """select split, source_index, 2 + source_index % 5 as table_size, 0.5e0 as small_blind_chips, 1.0e0 as big_blind_chips, cast(50 + source_index % 51 as double) as starting_stack_chips,
  concat('UTG,HJ,', hero_pos) as positions, hero_pos as slot_hero_pos, hero_holding as slot_hero_hole, cast(3 + source_index % 40 as double) + 0.5 as pot_size_chips from raw""")
def fn_parse_slots(spark, sf):
    s = prompts.slots(F.col("instruction"))
    s["positions"] = F.array_join(s["positions"], ",")
    s["table_size"] = s["table_size"].cast("long")
    return _raw(spark, sf).select("split", "source_index", *[v.alias(k) for k, v in s.items()])


@query("fn_template_shell", duck.RAW.join(["with ", ""]) + """select split, source_index, 'You are playing a <N>-handed game. The player positions involved in this game are <POSITIONS>. The small blind is <SB> chips and the big blind is <BB> chips. Everyone started with <STACK> chips. In this hand, your position is <POS>, and your holding is [<HOLDING>]. Before the flop, <PREV_LINE>. Assume that all other players that is not mentioned folded. The current pot size is <POT> chips.' as shell, substr(sha1(instruction), 1, 16) as row_id from raw""")
def fn_template_shell(spark, sf):
    return _raw(spark, sf).select("split", "source_index", prompts.shell(F.col("instruction")).alias("shell"), prompts.row_id(F.col("instruction")).alias("row_id"))


@query("fn_canonical_label", duck.BASE + """select source_index, canonical_label, case when source_index % 13 in (9, 11, 12) then 'unknown' else canonical_label end as legacy_label, cast(label_bet as double) as bet,
  case when canonical_label is null then '' else canonical_label end as text from sit""")
def fn_canonical_label(spark, sf):
    label = F.col("correct_decision")
    return _raw(spark, sf).select("source_index", labels.canonical(label).alias("canonical_label"), labels.canonical_or_unknown(label).alias("legacy_label"), labels.bet_size(label).alias("bet"), F.coalesce(labels.canonical(label), F.lit("")).alias("text"))


@query("fn_hand_class", duck.CHEN + "select source_index, hand_class, class_index, hi, lo, gap, suited, chen, hi = lo as pair, lo >= 10 as broadway, gap = 0 and hi <> lo as connector from chen")
def fn_hand_class(spark, sf):
    h = F.col("hero_holding")
    return _raw(spark, sf).select("source_index", cards.hand_class(h).alias("hand_class"), cards.hand_class_index(h).alias("class_index"), cards.high(h).alias("hi"), cards.low(h).alias("lo"), cards.gap(h).alias("gap"), cards.is_suited(h).alias("suited"), cards.chen(h).alias("chen"), cards.is_pair(h).alias("pair"), cards.is_broadway(h).alias("broadway"), cards.is_connector(h).alias("connector"))


_EQ = "(values " + ", ".join(f"('{k}', cast({v} as double))" for k, v in cards.EQUITY.items()) + ") as q(hand_class, equity)"
_FACTOR = "case aggressor when 'UTG' then 0.85e0 when 'HJ' then 0.88e0 when 'CO' then 0.92e0 when 'BTN' then 0.95e0 when 'SB' then 0.9e0 else 1.0e0 end"
_EQUITY = f"coalesce(q.equity, 0.3e0 + greatest(0.0e0, least(1.0e0, (chen + 1.0e0) / 21.0e0)) * 0.4e0)"


@query("join_equity_lookup", duck.CHEN + f"select source_index, {_EQUITY} as equity from chen left join {_EQ} using (hand_class)")
def join_equity_lookup(spark, sf):
    return _raw(spark, sf).select("source_index", cards.equity_vs_random(F.col("hero_holding")).alias("equity"))


@query("join_range_discount", duck.with_(duck.RAW, duck.EVENTS, duck.COUNTS, duck.HANDS) + f"select source_index, {_EQUITY} * {_FACTOR} as equity from chen left join cnt using (split, source_index) left join {_EQ} using (hand_class)")
def join_range_discount(spark, sf):
    return _raw(spark, sf).select("source_index", cards.equity_vs_range(F.col("hero_holding"), lines.last_aggressor(lines.events(F.col("prev_line")))).alias("equity"))


@query("win_villain_fold", duck.with_(duck.RAW, duck.EVENTS, duck.COUNTS) + """, answer as (select ev.split, ev.source_index, arg_min(action, seq) as a from ev join cnt using (split, source_index) where seq > last_seq and action in ('fold', 'call', 'raise', 'allin') group by 1, 2)
select raw.source_index, case when a is null then -1 when a = 'fold' then 1 else 0 end as villain_fold from raw left join answer using (split, source_index)""")
def win_villain_fold(spark, sf):
    return _light(spark, sf).select("source_index", lines.villain_fold(F.col("events")).alias("villain_fold"))


@query("win_last_aggressor", duck.with_(duck.RAW, duck.EVENTS, duck.COUNTS) + """, o as (select split, source_index, arg_max(position, seq) as other from ev where action in ('raise', 'allin') and position <> hero_pos group by 1, 2)
select raw.source_index, aggressor, other from raw left join cnt using (split, source_index) left join o using (split, source_index)""")
def win_last_aggressor(spark, sf):
    return _light(spark, sf).select("source_index", lines.last_aggressor(F.col("events")).alias("aggressor"), lines.last_aggressor(F.col("events"), F.col("hero_pos")).alias("other"))


_P1, _P2, _P5, _M = 11400714785074694791, 14029467366897019727, 2870177450012600261, 1 << 64
_STEP = f"(a + c * {_P2}::uhugeint) % {_M}::uhugeint"
#: The interpreter's hash of a tuple of small integers in 64-bit arithmetic, then modulo 1000 as a signed number.
PATTERN = f"""
codes as (select split, source_index, list((case action when 'post' then 0 when 'fold' then 1 when 'call' then 2 when 'raise' then 3 when 'allin' then 4 else 5 end)::uhugeint order by seq) filter (where seq < 6) as l from ev group by 1, 2),
lists6 as (select split, source_index, coalesce(l, []) as l from raw left join codes using (split, source_index)),
mixed as (select split, source_index, len(l) as n, list_reduce(l, lambda a, c: ((({_STEP}) * {1 << 31}::uhugeint % {_M}::uhugeint + ({_STEP}) // {1 << 33}::uhugeint) * {_P1}::uhugeint) % {_M}::uhugeint, {_P5}::uhugeint) as acc from lists6),
added as (select split, source_index, (acc + (case n {' '.join(f'when {n} then {n ^ (_P5 ^ 3527539)}::uhugeint' for n in range(7))} end)) % {_M}::uhugeint as h from mixed),
pat as (select split, source_index, cast(case when h >= {1 << 63}::uhugeint then (h % 1000 + {1000 - (1 << 64) % 1000}) % 1000 else h % 1000 end as int) as pattern_hash from added)
"""
_F = lambda c: f"cast(({c})::int as double)"
_RAISES = "coalesce(n_raise + n_allin, 0)"
_POS = "case {} when 'UTG' then 0 when 'HJ' then 1 when 'CO' then 2 when 'BTN' then 3 when 'SB' then 4 when 'BB' then 5 end"
FEATURE_ROW = duck.with_(duck.RAW, duck.EVENTS, duck.COUNTS, duck.HANDS, PATTERN) + f""", x as (
  select raw.*, hand_class, class_index, hi, lo, suited, gap, chen, n, n_raise, n_allin, n_call, n_fold, last_bet, aggressor, coalesce(max_bet, 0) as b, coalesce(nullif(raw.hero_stack_bb, 0), 100) as s, pot_size as p, {_EQUITY} as eq, {_POS.format('raw.hero_pos')} as i, pattern_hash
  from raw join chen using (split, source_index) left join cnt using (split, source_index) left join pat using (split, source_index) left join {_EQ} using (hand_class))
select split, source_index, {_F('class_index')} as hand_class_idx, {_F('hi')} as high_rank, {_F('lo')} as low_rank, {_F('hi = lo')} as is_pair, {_F('suited')} as is_suited, {_F('gap = 0 and hi <> lo')} as is_connector, {_F('lo >= 10')} as is_broadway, {_F('gap')} as gap, chen as chen_strength,
  eq as equity_vs_random, eq * {_FACTOR} as equity_vs_range, {_F('i')} as pos_idx, {_F('i >= 4')} as pos_is_blind, {_F('i = 3')} as pos_is_btn, {_F('i <= 1')} as pos_is_early, {_F('case when i < num_players then num_players - 1 - i else 0 end')} as seats_to_act_after, {_F('num_players')} as num_players, {_F('(9 - i) % 6')} as position_relative,
  {_F('coalesce(n, 0)')} as num_events, {_F(_RAISES)} as num_raises, {_F('coalesce(n_call, 0)')} as num_callers, {_F('coalesce(n_fold, 0)')} as num_folds, {_F('coalesce(n_allin, 0)')} as num_allins, coalesce(last_bet, 0) as last_bet_bb, b as max_bet_bb, {_F(f"coalesce({_POS.format('aggressor')}, -1)")} as aggressor_pos_idx,
  {_F(f'{_RAISES} = 0')} as is_open_pot, {_F(f'{_RAISES} >= 2')} as is_3bet_pot, {_F(f'{_RAISES} >= 3')} as is_4bet_pot, {_F(f'{_RAISES} >= 2 and n_call >= 1')} as is_squeeze, {_F('pattern_hash')} as action_pattern_hash,
  s as hero_stack_bb, p as pot_bb, b as facing_bet_bb, case when b + p > 0 then b / (b + p) else 0 end as pot_odds, case when p > 0 then s / p else 0 end as spr_proxy, {_F('s <= 25')} as allin_threshold, {_F('s >= 100')} as deep_stack, case when s + p > 0 then b / (s + p) else 0 end as pot_commitment, least(s, p + b) as effective_stack_bb,
  {_F('source_index % 5 = 1')} as can_check, {_F('source_index % 5 in (0, 1, 4)')} as can_fold, {_F('source_index % 5 = 0')} as can_call, {duck.canonical('correct_decision')} as label,
  case when a is null then -1 when a = 'fold' then 1 else 0 end as villain_fold
from x left join (select ev.split, ev.source_index, arg_min(action, seq) as a from ev join cnt using (split, source_index) where seq > last_seq and action in ('fold', 'call', 'raise', 'allin') group by 1, 2) answer using (split, source_index)"""


@query("prj_feature_row", FEATURE_ROW)
def prj_feature_row(spark, sf):
    return features.features(features.samples(_raw(spark, sf)))


@query("fn_action_features", duck.with_(duck.RAW, duck.EVENTS, duck.COUNTS) + """select raw.source_index, cast(coalesce(n, 0) as double) as num_events, cast(coalesce(n_raise + n_allin, 0) as double) as num_raises, cast(coalesce(n_call, 0) as double) as num_callers, cast(coalesce(n_fold, 0) as double) as num_folds,
  cast(coalesce(n_allin, 0) as double) as num_allins, coalesce(last_bet, 0) as last_bet_bb, coalesce(max_bet, 0) as max_bet_bb, cast(coalesce(case aggressor when 'UTG' then 0 when 'HJ' then 1 when 'CO' then 2 when 'BTN' then 3 when 'SB' then 4 when 'BB' then 5 end, -1) as double) as aggressor_pos_idx,
  cast(coalesce(n_raise + n_allin, 0) = 0 as int)::double as is_open_pot, cast(coalesce(n_raise + n_allin, 0) >= 2 as int)::double as is_3bet_pot, cast(coalesce(n_raise + n_allin, 0) >= 3 as int)::double as is_4bet_pot, cast(coalesce(n_raise + n_allin, 0) >= 2 and n_call >= 1 as int)::double as is_squeeze
  from raw left join cnt using (split, source_index)""")
def fn_action_features(spark, sf):
    return _light(spark, sf).select("source_index", *[c.alias(n) for n, c in features.action_features(F.col("events")).items()])


@query("fn_position_features", duck.RAW.join(["with ", ""]) + """, x as (select *, case hero_pos when 'UTG' then 0 when 'HJ' then 1 when 'CO' then 2 when 'BTN' then 3 when 'SB' then 4 else 5 end as i from raw)
select source_index, cast(i as double) as pos_idx, cast(i >= 4 as int)::double as pos_is_blind, cast(i = 3 as int)::double as pos_is_btn, cast(i <= 1 as int)::double as pos_is_early,
  cast(case when i < num_players then num_players - 1 - i else 0 end as double) as seats_to_act_after, cast(num_players as double) as num_players, cast((9 - i) % 6 as double) as position_relative from x""")
def fn_position_features(spark, sf):
    return _raw(spark, sf).select("source_index", *[c.alias(n) for n, c in features.position_features(F.col("hero_pos"), F.col("num_players")).items()])


@query("fn_stack_features", duck.with_(duck.RAW, duck.EVENTS, duck.COUNTS) + """, x as (select raw.source_index, coalesce(nullif(hero_stack_bb, 0), 100) as s, pot_size as p, coalesce(max_bet, 0) as b from raw left join cnt using (split, source_index))
select source_index, s as hero_stack_bb, p as pot_bb, b as facing_bet_bb, case when b + p > 0 then b / (b + p) else 0 end as pot_odds, case when p > 0 then s / p else 0 end as spr_proxy, cast(s <= 25 as int)::double as allin_threshold,
  cast(s >= 100 as int)::double as deep_stack, case when s + p > 0 then b / (s + p) else 0 end as pot_commitment, least(s, p + b) as effective_stack_bb from x""")
def fn_stack_features(spark, sf):
    s = features.samples(_raw(spark, sf))
    return s.select("source_index", *[c.alias(n) for n, c in features.stack_features(F.col("stack"), F.col("pot"), lines.facing_bet(F.col("events"))).items()])


@query("fn_board_texture", duck.RAW.join(["with ", ""]) + """, c as (select source_index, unnest([substr(board, 1, 2), substr(board, 3, 2), substr(board, 5, 2)]) as card from raw),
r as (select source_index, strpos('23456789TJQKA', substr(card, 1, 1)) + 1 as r, substr(card, 2, 1) as s from c),
rc as (select source_index, r, count(*) as n from r group by 1, 2), sc as (select source_index, max(n) as most from (select source_index, s, count(*) as n from r group by 1, 2) group by 1),
isl as (select source_index, count(*) as len from (select source_index, r - row_number() over (partition by source_index order by r) as g from rc) group by source_index, g), run as (select source_index, max(len) as run from isl group by 1)
select source_index, cast(max(r) as double) as board_high_card, cast(min(r) as double) as board_low_card, cast(max(r) - min(r) as double) as board_spread, cast(max(n) >= 2 as int)::double as board_is_paired, cast(max(n) >= 3 as int)::double as board_is_trips,
  cast(max(most) >= 3 as int)::double as board_is_monotone, cast(max(most) >= 3 as int)::double as board_flush_possible, cast(max(most) >= 2 as int)::double as board_flush_draw, cast(max(most) as double) as board_max_suit_count,
  cast(max(run) >= 3 or (bool_or(r = 14) and bool_or(r = 2) and bool_or(r = 3)) as int)::double as board_straight_possible, cast(max(run) as double) as board_max_connected,
  cast(sum(case when r >= 10 then n else 0 end) as double) as board_num_broadway, cast(sum(case when r <= 6 then n else 0 end) as double) as board_num_low, 3.0e0 as board_n_cards
  from rc join sc using (source_index) join run using (source_index) group by source_index""")
def fn_board_texture(spark, sf):
    df = _raw(spark, sf).select("source_index", cards.cards_of(F.col("board")).alias("b"))
    return df.select("source_index", *[c.alias(n) for n, c in cards.board_texture(F.col("b")).items()])


_POP = """, firsts as (select * from (select *, row_number() over (partition by split, source_index, position order by seq) as r from ev) where r = 1),
facing as (select *, coalesce(max(cast(action in ('raise', 'allin') as int)) over (partition by split, source_index order by seq rows between unbounded preceding and 1 preceding), 0) as f from firsts),
pop as (select position, count(*) as hands, count(*) filter (where action in ('call', 'raise', 'allin')) / count(*)::double as vpip, count(*) filter (where action in ('raise', 'allin')) / count(*)::double as pfr,
  count(*) filter (where f = 1 and action in ('raise', 'allin')) / greatest(count(*) filter (where f = 1), 1)::double as three_bet_pct, count(*) filter (where f = 1 and action = 'fold') / greatest(count(*) filter (where f = 1), 1)::double as fold_to_raise_pct from facing group by 1)
"""


@query("agg_population_stats", duck.with_(duck.RAW, duck.EVENTS).rstrip() + _POP + "select *, pfr / greatest(vpip, 0.01e0) as aggression from pop")
def agg_population_stats(spark, sf):
    return features.population(features.samples(_raw(spark, sf)))


@query("fn_opponent_features", duck.with_(duck.RAW, duck.EVENTS).rstrip() + _POP + """, lastp as (select split, source_index, position, arg_max(action, seq) as a from ev where position <> hero_pos group by 1, 2, 3), act as (select split, source_index, count(*) filter (where a <> 'fold') as n from lastp group by 1, 2),
o as (select split, source_index, arg_max(position, seq) as position from ev where action in ('raise', 'allin') and position <> hero_pos group by 1, 2)
select raw.source_index, coalesce(act.n, 0) as n_active_opponents, coalesce(vpip, 0) as villain_vpip, coalesce(pfr, 0) as villain_pfr, coalesce(three_bet_pct, 0) as villain_three_bet_pct, coalesce(fold_to_raise_pct, 0) as villain_fold_to_raise_pct, coalesce(pfr / greatest(vpip, 0.01e0), 0) as villain_aggression
from raw left join act using (split, source_index) left join o using (split, source_index) left join pop using (position)""")
def fn_opponent_features(spark, sf):
    s = features.samples(_raw(spark, sf))
    out = features.opponent_features(s, features.population(s))
    return out.drop("split").withColumn("n_active_opponents", F.col("n_active_opponents").cast("long"))


@query("fn_legacy_hand_strength", duck.CHEN + f"select source_index, coalesce(g, 9) as hand_group, 1.0e0 / coalesce(g, 9) as hand_strength, cast(coalesce(g, 9) <= 2 as int) as is_premium, cast(coalesce(g, 9) <= 5 as int) as is_playable from chen left join (values {', '.join(f'({chr(39)}{h}{chr(39)}, {i})' for i, g in enumerate(features.GROUPS, 1) for h in g.split())}) as q(hand_class, g) using (hand_class)")
def fn_legacy_hand_strength(spark, sf):
    return _raw(spark, sf).select("source_index", *[c.alias(n) for n, c in features.legacy_strength(F.col("hero_holding")).items()])


@query("fn_pot_odds_legacy", duck.RAW.join(["with ", ""]) + "select source_index, case when num_bets > 0 then pot_size / (pot_size + num_bets) else 0 end as pot_odds_legacy, case when pot_size > 0 then least(50.0, 5 * pot_size / pot_size) else 999 end as spr_legacy from raw")
def fn_pot_odds_legacy(spark, sf):
    return _raw(spark, sf).select("source_index", *[c.alias(n) for n, c in features.legacy_pot(F.col("pot_size"), F.col("num_bets").cast("double")).items()])


@query("fn_legacy_sequence", duck.with_(duck.RAW) + """, t as (select source_index, list_filter(string_split(coalesce(prev_line, ''), '/'), lambda x: x <> '') as l from raw),
a as (select source_index, list_transform(range(1, len(l) // 2 + 1), lambda i: l[2 * i]) as a from t), f as (select source_index, a, list_position(list_transform(a, lambda x: contains(lower(x), 'bb')), true) as f from a)
select source_index, array_to_string(list_transform(a, lambda x, i: case when not contains(lower(x), 'bb') then x when i = f then 'bet' else 'raise' end), ',') as seq from f""")
def fn_legacy_sequence(spark, sf):
    return _raw(spark, sf).select("source_index", F.array_join(lines.legacy_actions(F.col("prev_line")), ",").alias("seq"))


@query("fil_sample_valid", duck.RAW.join(["with ", ""]) + "select source_index, case source_index % 9 when 1 then 'hole' when 2 then 'hole' when 3 then 'position' when 4 then 'players' when 5 then 'players' when 6 then 'negative' when 7 then 'negative' end as reason from raw")
def fil_sample_valid(spark, sf):
    """Samples, most of them spoilt in one way: a card twice, an unknown card, seat or number of players, negative chips."""
    spoilt = {1: ("hero_hole", F.lit("AhAh")), 2: ("hero_hole", F.lit("1hKd")), 3: ("hero_pos", F.lit("MP")), 4: ("num_players", F.lit(0)), 5: ("num_players", F.lit(10)), 6: ("pot", F.lit(-1.0)), 7: ("stack", F.lit(-0.5))}
    df = features.samples(_raw(spark, sf))
    for k, (column, value) in spoilt.items():
        df = df.withColumn(column, F.when(F.col("source_index") % 9 == k, value).otherwise(F.col(column)))
    return df.select("source_index", features.reject_reason(df).alias("reason"))


@query("fil_label_known", duck.BASE + "select source_index, canonical_label from sit where canonical_label is not null")
def fil_label_known(spark, sf):
    return _light(spark, sf).where("canonical_label is not null").select("source_index", "canonical_label")


@query("prj_samples_flat", duck.BASE + """select sit.split, sit.source_index, sit.hero_pos, hero_holding as hero_hole, hand_class, num_players, num_bets, pot_size as pot, cast(coalesce(cnt.n, 0) as int) as n_actions,
  case sit.source_index % 5 when 0 then 'fold,call,raise' when 1 then 'check,Fold' when 2 then 'fold, call,' when 3 then '' else 'fold,allin,fold' end as moves, canonical_label as label from sit left join cnt using (split, source_index)""")
def prj_samples_flat(spark, sf):
    return features.flat(features.samples(_raw(spark, sf)))


# The cookbook.
@query("win_share", duck.BASE + "select hero_pos, canonical_label, count(*) as n, 100.0e0 * count(*) / sum(count(*)) over (partition by hero_pos) as pct from sit where canonical_label is not null group by 1, 2")
def win_share(spark, sf):
    return spark.sql("select hero_pos, canonical_label, count(*) as n, 100.0E0 * count(*) / sum(count(*)) over (partition by hero_pos) as pct from {s} where canonical_label is not null group by 1, 2", s=_light(spark, sf))


@query("agg_cond_count", duck.BASE + "select hand_class as hero_hand_class, count(*) filter (where canonical_label = 'raise') as n_raise, count(*) filter (where canonical_label = 'call') as n_call, count(*) filter (where canonical_label = 'fold') as n_fold, count(*) as n from sit where hero_pos = 'BTN' group by 1 order by 2 desc, 3 desc, 1 limit 25")
def agg_cond_count(spark, sf):
    return spark.sql("select hero_hand_class, count_if(canonical_label = 'raise') as n_raise, count_if(canonical_label = 'call') as n_call, count_if(canonical_label = 'fold') as n_fold, count(*) as n from {s} where hero_pos = 'BTN' group by 1 order by n_raise desc, n_call desc, hero_hand_class limit 25", s=_light(spark, sf))


@query("agg_nested_hist", duck.with_(duck.RAW, duck.EVENTS) + "select n_actions, count(*) as n_situations from (select source_index, count(*) as n_actions from ev group by 1) group by 1 order by 1")
def agg_nested_hist(spark, sf):
    return spark.sql("select n_actions, count(*) as n_situations from (select cast(size(events) as bigint) as n_actions from {s}) where n_actions > 0 group by 1 order by 1", s=_light(spark, sf))


@query("agg_cond_rate", duck.BASE + "select hero_pos, avg(cast(coalesce(canonical_label, '') = 'raise' as int)) * 100 as pct_4bet, avg(cast(coalesce(canonical_label, '') = 'call' as int)) * 100 as pct_call, avg(cast(coalesce(canonical_label, '') = 'fold' as int)) * 100 as pct_fold, count(*) as n from sit where decision_type = '3bet_facing' group by 1")
def agg_cond_rate(spark, sf):
    return spark.sql("select hero_pos, avg(int(coalesce(canonical_label, '') = 'raise')) * 100 as pct_4bet, avg(int(coalesce(canonical_label, '') = 'call')) * 100 as pct_call, avg(int(coalesce(canonical_label, '') = 'fold')) * 100 as pct_fold, count(*) as n from {s} where decision_type = '3bet_facing' group by 1", s=_light(spark, sf))


@query("agg_having_alias", duck.BASE + "select hand_class as hero_hand_class, avg(cast(coalesce(canonical_label, '') = 'call' as int)) * 100 as pct_call_allin, count(*) as n_spots from sit where decision_type = 'allin_facing' group by 1 having count(*) >= 30 order by 2 desc, 1 limit 25")
def agg_having_alias(spark, sf):
    return spark.sql("select hero_hand_class, avg(int(coalesce(canonical_label, '') = 'call')) * 100 as pct_call_allin, count(*) as n_spots from {s} where decision_type = 'allin_facing' group by 1 having n_spots >= 30 order by pct_call_allin desc, hero_hand_class limit 25", s=_light(spark, sf))


@query("agg_avg_raise", duck.BASE + "select hero_pos, avg(cast(label_bet as double)) as avg_raise_bb, count(*) as n from sit where canonical_label = 'raise' and label_bet is not null group by 1")
def agg_avg_raise(spark, sf):
    return _light(spark, sf).where("canonical_label = 'raise' and label_bet_bb is not null").groupBy("hero_pos").agg(F.avg("label_bet_bb").alias("avg_raise_bb"), F.count("*").alias("n"))


@query("agg_group_concat", duck.BASE + "select situation_id, sit.hero_pos, string_agg(position || '/' || action || coalesce('/' || cast(amount as varchar) || 'bb', ''), ' | ' order by seq) as reconstructed_line, canonical_label from sit join ev using (split, source_index) group by situation_id, sit.hero_pos, canonical_label")
def agg_group_concat(spark, sf):
    """The line is put together in the row that has the events; only numbering moves rows."""
    df = _light(spark, sf)
    said = F.transform("events", lambda e: F.concat_ws("/", e["position"], e["action"], F.concat(e["amount_bb"].cast("string"), F.lit("bb"))))
    rows = df.where(promptdb.is_accepted(df)).select("split", "source_index", "hero_pos", F.array_join(said, " | ").alias("reconstructed_line"), "canonical_label")
    return promptdb.with_situation_id(rows).where("reconstructed_line <> ''").select("situation_id", "hero_pos", "reconstructed_line", "canonical_label")


@query("top_labels", duck.BASE + "select lower(raw_label) as raw_label, count(*) as n_occurrences from sit where raw_label is not null group by 1 order by 2 desc, 1 limit 15")
def top_labels(spark, sf):
    return promptdb.taxonomy(_light(spark, sf)).orderBy(F.desc("n_occurrences"), "raw_label").limit(15).select("raw_label", "n_occurrences")


@query("join_taxonomy", duck.BASE + "select lower(raw_label) as raw_label, canonical_label, cast(min(label_bet) as double) as bet_size_bb, count(*) as n_occurrences from sit where canonical_label = 'raise' group by 1, 2 order by 4 desc, 1 limit 20")
def join_taxonomy(spark, sf):
    return promptdb.taxonomy(_light(spark, sf)).where("canonical_label = 'raise'").orderBy(F.desc("n_occurrences"), "raw_label").limit(20)


@query("top_hand_pos", duck.BASE + "select hand_class as hero_hand_class, hero_pos, count(*) as n from sit group by 1, 2 order by 3 desc, 1, 2 limit 25")
def top_hand_pos(spark, sf):
    return _light(spark, sf).groupBy("hero_hand_class", "hero_pos").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hero_hand_class", "hero_pos").limit(25)


@query("top_hands_eda", duck.BASE + "select hand_class as hero_hand_class, count(*) as n from sit group by 1 order by 2 desc, 1 limit 20")
def top_hands_eda(spark, sf):
    return _light(spark, sf).groupBy("hero_hand_class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hero_hand_class").limit(20)


@query("fil_between", duck.BASE + "select source_index, hero_pos, hero_holding as hero_hole, canonical_label, concat(substr(instruction, 1, 300), '...') as prompt_head from sit where split = 'test' and source_index between 0 and 40 order by 1")
def fil_between(spark, sf):
    return _raw(spark, sf).where("split = 'test' and source_index between 0 and 40").select("source_index", "hero_pos", F.col("hero_holding").alias("hero_hole"), labels.canonical(F.trim("correct_decision")).alias("canonical_label"), F.concat(F.substring("instruction", 1, 300), F.lit("...")).alias("prompt_head")).orderBy("source_index")


@query("agg_pivot_share", duck.BASE + """, x as (select * from sit where canonical_label is not null) select hero_pos, """ + ", ".join(f"count(*) filter (where canonical_label = '{a}') / count(*)::double as share_{a}" for a in ("fold", "check", "call", "raise", "allin")) + " from x group by 1")
def agg_pivot_share(spark, sf):
    return metrics.pivot_share(_light(spark, sf).where("canonical_label is not null"), "hero_pos", "canonical_label", ["fold", "check", "call", "raise", "allin"], list(lines.POSITIONS))


@query("agg_hand_pivot", duck.BASE + """, x as (select * from sit where canonical_label is not null) select hand_class as hero_hand_class, """ + ", ".join(f"count(*) filter (where canonical_label = '{a}') / count(*)::double as share_{a}" for a in ("fold", "check", "call", "raise", "allin")) + " from x group by 1")
def agg_hand_pivot(spark, sf):
    return metrics.pivot_share(_light(spark, sf).where("canonical_label is not null"), "hero_hand_class", "canonical_label", ["fold", "check", "call", "raise", "allin"])


@query("agg_value_counts", duck.BASE + "select coalesce(canonical_label, 'none') as label, count(*) as n, count(*) / (select count(*) from sit)::double as share from sit group by 1")
def agg_value_counts(spark, sf):
    n = _light(spark, sf).groupBy(F.coalesce("canonical_label", F.lit("none")).alias("label")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("agg_describe", duck.RAW.join(["with ", ""]) + "select count(pot_size) as n, avg(pot_size) as mean, stddev_samp(pot_size) as std, min(pot_size) as min, quantile_cont(pot_size, 0.1) as p10, quantile_cont(pot_size, 0.5) as p50, quantile_cont(pot_size, 0.9) as p90, max(pot_size) as max from raw")
def agg_describe(spark, sf):
    return metrics.describe(_raw(spark, sf), "pot_size")


@query("agg_clip_p99", duck.RAW.join(["with ", ""]) + ", q as (select quantile_cont(pot_size, 0.99) as top from raw) select cast(least(39, floor(least(pot_size, top) / (top / 40))) as int) as bin, count(*) as n from raw, q group by 1")
def agg_clip_p99(spark, sf):
    return metrics.clipped_histogram(_raw(spark, sf), "pot_size")


@query("lim_head", duck.RAW.join(["with ", ""]) + "select split, source_index from raw where source_index < 100")
def lim_head(spark, sf):
    return _raw(spark, sf).where("source_index < 100").select("split", "source_index")


@query("smp_tail_holdout", duck.RAW.join(["with ", ""]) + "select source_index from raw where source_index >= floor(0.8 * (select max(source_index) + 1 from raw))")
def smp_tail_holdout(spark, sf):
    raw = _raw(spark, sf).select("source_index")
    n = raw.agg((F.max("source_index") + 1).alias("n"))
    return raw.crossJoin(F.broadcast(n)).where("source_index >= floor(0.8E0 * n)").select("source_index")


@query("smp_stratified_split", duck.BASE + ", n as (select canonical_label as y, count(*) as n from sit where canonical_label is not null group by 1) select y, n, cast(round_even(n * 0.1, 0) as bigint) as holdout from n")
def smp_stratified_split(spark, sf):
    df = _light(spark, sf).where("canonical_label is not null").select(F.col("canonical_label").alias("y"), "source_index")
    return metrics.stratified_split(df, "y", "source_index", 0.1).groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("part") == "holdout").alias("holdout"))


@query("smp_kfold", duck.BASE + ", n as (select canonical_label as y, count(*) as n from sit where canonical_label is not null group by 1) select y, f as fold, (n + 4 - f) // 5 as n from n, range(5) t(f)")
def smp_kfold(spark, sf):
    df = _light(spark, sf).where("canonical_label is not null").select(F.col("canonical_label").alias("y"), "source_index")
    return metrics.folds(df, "y", "source_index").groupBy("y", F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"))


@query("win_stratified_cap", duck.BASE + ", n as (select canonical_label as y, count(*) as n from sit where canonical_label is not null group by 1) select y, least(n, 1000 // (select count(*) from n)) as n from n")
def win_stratified_cap(spark, sf):
    df = _light(spark, sf).where("canonical_label is not null").select(F.col("canonical_label").alias("y"), "source_index")
    return metrics.class_cap(df, "y", "source_index", 1000).groupBy("y").agg(F.count("*").alias("n"))


@query("snk_sft_jsonl", duck.RAW.join(["with ", ""]) + "select 'system' as r0, 'You decide.' as c0, 'user' as r1, instruction as c1, 'assistant' as r2, trim(correct_decision) as c2 from raw where trim(coalesce(correct_decision, '')) <> ''")
def snk_sft_jsonl(spark, sf):
    df = rewards.scenario_records(_raw(spark, sf).withColumn("output", F.col("correct_decision")), "You decide.", preflop_only=False)
    m = lambda i: F.get("messages", F.lit(i))
    return df.select(*[x for i in range(3) for x in (m(i)["role"].alias(f"r{i}"), m(i)["content"].alias(f"c{i}"))])


@query("fil_preflop_only", duck.RAW.join(["with ", ""]) + "select instruction as c1 from raw where trim(coalesce(correct_decision, '')) <> '' and not (contains(lower(instruction), 'flop') and not contains(substr(lower(instruction), 1, 80), 'preflop'))")
def fil_preflop_only(spark, sf):
    df = rewards.scenario_records(_raw(spark, sf).withColumn("output", F.col("correct_decision")), "You decide.")
    return df.select(F.get("messages", F.lit(1))["content"].alias("c1"))


@query("join_resume_anti", "select substr(sha1(text), 1, 16) as row_id, count(*) as n from documents d where not exists (select 1 from documents e where e.doc_id % 3 = 0 and sha1(e.text) = sha1(d.text)) group by 1")
def join_resume_anti(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", prompts.row_id(F.col("text")).alias("row_id"))
    return rewards.pending(docs, docs.where("doc_id % 3 = 0")).groupBy("row_id").agg(F.count("*").alias("n"))


@query("agg_build_stats", duck.BASE + "select count(*) as n_situations, (select count(*) from ev) as n_actions, cast(sum(case source_index % 5 when 0 then 3 when 1 then 2 when 2 then 2 when 3 then 0 else 3 end) as bigint) as n_moves, 3 * count(*) as n_positions, cast(0 as bigint) as n_unparseable from sit")
def agg_build_stats(spark, sf):
    """Counters of a build; moves and seats are counted before repeated ones are left out."""
    df = promptdb.parsed(_raw(spark, sf))
    ok = promptdb.is_accepted(df)
    n = lambda c: F.sum(F.when(ok, F.size(c)).otherwise(0))
    return df.agg(F.count_if(ok).alias("n_situations"), n(F.col("events")).alias("n_actions"), n(labels.moves(F.col("available_moves"))).alias("n_moves"), n(F.col("positions")).alias("n_positions"), F.count_if(~ok).alias("n_unparseable"))


@query("src_zip_csv_json", duck.RAW.join(["with ", ""]) + ", a as (select *, row_number() over (order by source_index) - 1 as i from raw) select i as source_index, hero_pos, hero_holding, prev_line, correct_decision, instruction from a")
def src_zip_csv_json(spark, sf):
    """Scenario rows written as CSV and as JSON lines, read again and zipped by position."""
    place = shared.place(spark, "zip")
    raw = _raw(spark, sf).orderBy("source_index")
    raw.select("prev_line", "hero_pos", "hero_holding", "correct_decision", "num_players", "num_bets", "available_moves", "pot_size").write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{place}/csv")
    raw.select("instruction", F.coalesce("correct_decision", F.lit("")).alias("output")).write.json(f"{place}/json")
    left = readers.with_index(readers.read_preflop(spark, f"{place}/csv"))
    right = readers.with_index(spark.read.schema(readers.PAIRS).json(f"{place}/json"))
    return left.join(right, "source_index").select("source_index", "hero_pos", "hero_holding", "prev_line", "correct_decision", "instruction")
