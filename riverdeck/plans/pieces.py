"""Queries of single functions, joins and sinks, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cards, labels, lines, prompts
from ..operators import features, metrics, promptdb, rewards
from ..sources import bridge, readers, sinks
from ..sources.shared import place as _place
from . import duck
from .registry import query

RAW = f"with {duck.RAW}"


def _raw(spark, sf):
    return bridge.scenarios(spark, sf)


def _ev(spark, sf):
    return _raw(spark, sf).withColumn("events", lines.events(F.col("prev_line")))


def _pred(spark, sf):
    return metrics.scored(bridge.predictions(spark, sf).withColumn("p", F.array("p0", "p1", "p2")))


_PRED = duck.PRED + ", s as (select *, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as pred, greatest(p0, p1, p2) as p_max, case y when 0 then p0 when 1 then p1 else p2 end as p_true from pred)\n"

# Cards.
query("fn_is_pair", duck.CHEN + "select source_index, hi = lo as is_pair from chen")(lambda spark, sf: _raw(spark, sf).select("source_index", cards.is_pair(F.col("hero_holding")).alias("is_pair")))
query("fn_chen", duck.CHEN + "select source_index, chen from chen")(lambda spark, sf: _raw(spark, sf).select("source_index", cards.chen(F.col("hero_holding")).alias("chen")))
query("fn_chen_to_equity", duck.CHEN + "select source_index, 0.3e0 + greatest(0.0e0, least(1.0e0, (chen + 1.0e0) / 21.0e0)) * 0.4e0 as equity from chen")(lambda spark, sf: _raw(spark, sf).select("source_index", cards.chen_to_equity(cards.chen(F.col("hero_holding"))).alias("equity")))


@query("fn_card_features", duck.CHEN + "select source_index, class_index::double as hand_class_idx, hi::double as high_rank, lo::double as low_rank, (hi = lo)::int::double as is_pair, suited::int::double as is_suited, (gap = 0 and hi <> lo)::int::double as is_connector, (lo >= 10)::int::double as is_broadway, gap::double as gap, chen as chen_strength from chen")
def fn_card_features(spark, sf):
    return _raw(spark, sf).select("source_index", *[c.alias(n) for n, c in features.card_features(F.col("hero_holding")).items()])


_EQ = "(values " + ", ".join(f"('{k}', cast({v} as double))" for k, v in cards.EQUITY.items()) + ") as q(hand_class, equity)"


_ANY = "coalesce(equity, 0.3e0 + greatest(0.0e0, least(1.0e0, (chen + 1.0e0) / 21.0e0)) * 0.4e0)"


@query("fn_equity_random", duck.CHEN + f"select source_index, {_ANY} as equity from chen left join {_EQ} using (hand_class)")
def fn_equity_random(spark, sf):
    """Equities of all hands: from the table, or from the hand's strength."""
    return _raw(spark, sf).select("source_index", cards.equity_vs_random(F.col("hero_holding")).alias("equity"))


@query("fn_equity_range", duck.CHEN + f"select source_index, {_ANY} * case hero_pos when 'UTG' then 0.85e0 when 'HJ' then 0.88e0 when 'CO' then 0.92e0 when 'BTN' then 0.95e0 when 'SB' then 0.9e0 else 1.0e0 end as equity from chen left join {_EQ} using (hand_class)")
def fn_equity_range(spark, sf):
    return _raw(spark, sf).select("source_index", cards.equity_vs_range(F.col("hero_holding"), F.col("hero_pos")).alias("equity"))


@query("fn_card_parse", RAW + "select source_index, cast(strpos('23456789TJQKA', substr(hero_holding, 1, 1)) + 1 as int) as rank, substr(hero_holding, 2, 1) as suit from raw")
def fn_card_parse(spark, sf):
    c = cards.first(F.col("hero_holding"))
    return _raw(spark, sf).select("source_index", cards.rank(c).alias("rank"), cards.suit(c).alias("suit"))


@query("fn_card_str", RAW + "select source_index, substr(hero_holding, 1, 2) as card from raw")
def fn_card_str(spark, sf):
    """A card taken apart and put together again."""
    c = cards.first(F.col("hero_holding"))
    return _raw(spark, sf).select("source_index", F.concat(F.substring(F.lit(cards.RANKS), cards.rank(c) - 1, F.lit(1)), cards.suit(c)).alias("card"))


@query("fn_board_cards", RAW + "select source_index, concat_ws(',', substr(board, 1, 2), substr(board, 3, 2), substr(board, 5, 2)) as board from raw")
def fn_board_cards(spark, sf):
    return _raw(spark, sf).select("source_index", F.array_join(cards.cards_of(F.col("board")), ",").alias("board"))


@query("fn_cards_list", RAW + "select source_index, regexp_extract(instruction, '\\[(.*?)\\]', 1) as text from raw")
def fn_cards_list(spark, sf):
    return _raw(spark, sf).select("source_index", F.array_join(F.transform(cards.cards_of(F.col("hero_holding")), cards.english), " and ").alias("text"))


_FIVE = f"""with c as (select * from ({bridge.SEVEN}) where i < 5), r as (select o_orderkey, c % 13 + 2 as r, (c - c % 13) // 13 as s from c), g as (select o_orderkey, r, count(*) as n from r group by 1, 2),
p as (select o_orderkey, string_agg(n, '' order by n desc) as pattern, max(r) as hi, min(r) as lo, count(*) as k, bool_and(r in (14, 2, 3, 4, 5)) as wheel, string_agg(r, ',' order by n desc, r desc) as groups from g group by 1), f as (select o_orderkey, count(distinct s) = 1 as flush, string_agg(r, ',' order by r desc) as down from r group by 1)
select o_orderkey, case when k = 5 and (hi - lo = 4 or wheel) then case when wheel then '5' else cast(hi as varchar) end when pattern not in ('41', '32') and flush then down else groups end as ranks, case when flush and k = 5 and (hi - lo = 4 or wheel) then 'straight_flush' when pattern = '41' then 'quads' when pattern = '32' then 'full_house' when flush then 'flush' when k = 5 and (hi - lo = 4 or wheel) then 'straight' when pattern = '311' then 'trips' when pattern = '221' then 'two_pair' when pattern = '2111' then 'pair' else 'high_card' end as category from p join f using (o_orderkey)"""


@query("fn_hand_score_5", _FIVE)
def fn_hand_score_5(spark, sf):
    c = bridge.seven_cards(spark, sf).where("i < 5")
    card = F.concat(F.substring(F.lit(cards.RANKS), (F.col("c") % 13 + 1).cast("int"), F.lit(1)), F.substring(F.lit(cards.SUITS), (F.floor(F.col("c") / 13) + 1).cast("int"), F.lit(1)))
    hands = c.groupBy("o_orderkey").agg(F.collect_list(card).alias("cards"))  # five a hand
    return cards.with_score(hands, "cards").select("o_orderkey", cards.category(F.col("score")).alias("category"), F.array_join(F.slice("score", 2, 5), ",").alias("ranks"))


_MADE = duck.CHEN.rstrip() + """, c as (select distinct source_index, card from (select source_index, unnest([substr(hero_holding, 1, 2), substr(hero_holding, 3, 2), substr(board, 1, 2), substr(board, 3, 2), substr(board, 5, 2)]) as card from raw) where length(card) = 2),
r as (select source_index, strpos('23456789TJQKA', substr(card, 1, 1)) + 1 as r, substr(card, 2, 1) as s from c), g as (select source_index, r, count(*) as n from r group by 1, 2), p as (select source_index, max(n) as m, count(*) filter (where n >= 2) as twos, max(r) filter (where n = 2) as paired, count(*) as k, max(r) - min(r) as span, bool_and(r in (14, 2, 3, 4, 5)) as wheel from g group by 1),
f as (select source_index, max(n) as same from (select source_index, s, count(*) as n from r group by 1, 2) group by 1)
select source_index, case when m >= 3 or same >= 5 or (k = 5 and (span = 4 or wheel)) then 3 when twos = 2 then 2 when m = 2 and hi = lo and paired = hi then 2 when m = 2 then 1 else 0 end as made from chen join p using (source_index) join f using (source_index)"""


@query("fn_made_hand", _MADE)
def fn_made_hand(spark, sf):
    df = _raw(spark, sf).select("source_index", "hero_holding", F.array_distinct(F.concat(cards.cards_of(F.col("hero_holding")), cards.cards_of(F.col("board")))).alias("cards"))
    return cards.with_score(df, "cards").select("source_index", features.made_hand(F.col("score"), F.col("hero_holding")).alias("made"))


@query("win_run_length", RAW + """, c as (select source_index, unnest([substr(board, 1, 1), substr(board, 3, 1), substr(board, 5, 1)]) as s from raw), r as (select distinct source_index, strpos('23456789TJQKA', s) + 1 as r from c),
g as (select source_index, r - row_number() over (partition by source_index order by r) as g from r), n as (select source_index, count(*) as n from g group by source_index, g) select source_index, cast(max(n) as int) as run from n group by 1""")
def win_run_length(spark, sf):
    ranks = F.array_distinct(F.transform(cards.cards_of(F.col("board")), cards.rank))
    return _raw(spark, sf).select("source_index", cards.longest_run(ranks).alias("run"))


@query("win_straight_high", f"""with c as ({bridge.SEVEN}), r as (select distinct o_orderkey, c % 13 + 2 as r from c), low as (select * from r union select o_orderkey, 1 from r where r = 14)
select a.o_orderkey, cast(max(a.r) as int) as high from low a where (select count(*) from low b where b.o_orderkey = a.o_orderkey and b.r between a.r - 4 and a.r) = 5 group by 1""")
def win_straight_high(spark, sf):
    ranks = bridge.seven_cards(spark, sf).groupBy("o_orderkey").agg(F.collect_set((F.col("c") % 13 + 2).cast("int")).alias("ranks"))
    return ranks.select("o_orderkey", cards.straight_high(F.col("ranks")).alias("high")).where("high is not null")


# Labels, prompts and lines.
query("fn_canonical_legacy", duck.BASE + "select source_index, case when source_index % 13 in (9, 11, 12) then 'unknown' else canonical_label end as label from sit")(lambda spark, sf: _raw(spark, sf).select("source_index", labels.canonical_or_unknown(F.col("correct_decision")).alias("label")))
query("fil_unknown_label", duck.BASE + "select source_index, canonical_label as label from sit where source_index % 13 not in (9, 11, 12)")(lambda spark, sf: _raw(spark, sf).select("source_index", labels.canonical_or_unknown(F.col("correct_decision")).alias("label")).where("label <> 'unknown'"))
query("fn_label_bet_bb", duck.BASE + "select source_index, cast(label_bet as double) as bet from sit")(lambda spark, sf: _raw(spark, sf).select("source_index", labels.bet_size(F.col("correct_decision")).alias("bet")))
query("fn_position_category", RAW + "select source_index, case when hero_pos = 'UTG' then 'early' when hero_pos = 'HJ' then 'middle' when hero_pos in ('CO', 'BTN') then 'late' else 'blinds' end as category from raw")(lambda spark, sf: _raw(spark, sf).select("source_index", labels.position_category(F.col("hero_pos")).alias("category")))
query("fn_decision_type", duck.BASE + "select source_index, decision_type from sit")(lambda spark, sf: _ev(spark, sf).select("source_index", lines.decision_type(F.col("events")).alias("decision_type")))
query("fn_is_open_pot", duck.BASE + "select source_index, open_pot from sit")(lambda spark, sf: _ev(spark, sf).select("source_index", lines.is_open(F.col("events")).alias("open_pot")))
query("fn_parse_holding", RAW + "select source_index, hero_holding as hole from raw")(lambda spark, sf: _raw(spark, sf).select("source_index", prompts.holding(F.col("instruction")).alias("hole")))
query("fn_n_slots", RAW + "select source_index, 10 as n_slots from raw")(lambda spark, sf: _raw(spark, sf).select("source_index", prompts.n_slots(prompts.shell(F.col("instruction"))).cast("int").alias("n_slots")))
query("fn_template_hash", RAW + "select source_index, substr(sha256(instruction), 1, 16) as h from raw")(lambda spark, sf: _raw(spark, sf).select("source_index", prompts.shell_hash(F.col("instruction")).alias("h")))
query("fn_format_action", duck.DECISION + "select decision_id, case when action = 'raise' then concat('raise ', rtrim(rtrim(printf('%.3f', amount_bb), '0'), '.'), 'bb') else action end as text from dec")(lambda spark, sf: bridge.decisions(spark, sf).select("decision_id", prompts.format_action(F.col("action"), F.col("amount_bb")).alias("text")))
_MOVES = "case source_index % 5 when 0 then 'fold,call,raise' when 1 then 'check,Fold' when 3 then '' when 4 then 'fold,allin,fold' else '{}' end"
query("fn_parse_moves_db", RAW + f"select source_index, {_MOVES.format('fold,call')} as moves from raw")(lambda spark, sf: _raw(spark, sf).select("source_index", F.array_join(labels.moves(F.col("available_moves")), ",").alias("moves")))
query("fn_coerce_moves", RAW + f"select source_index, {_MOVES.format('fold, call,')} as moves from raw")(lambda spark, sf: _raw(spark, sf).select("source_index", F.array_join(labels.moves(F.col("available_moves"), "whole"), ",").alias("moves")))
query("fn_legacy_cards", RAW + "select source_index, substr(hero_holding, 1, 1) as card1_rank, substr(hero_holding, 2, 1) as card1_suit, substr(hero_holding, 3, 1) as card2_rank, substr(hero_holding, 4, 1) as card2_suit from raw")(lambda spark, sf: _raw(spark, sf).select("source_index", *[c.alias(n) for n, c in features.legacy_cards(F.col("hero_holding")).items()]))


@query("fn_extract_decision", "select event_id, case when contains(lower(props), 'fold') then 'fold' when contains(lower(props), 'check') then 'check' when contains(lower(props), 'call') then 'call' when contains(lower(props), 'raise') then 'raise' when contains(lower(props), 'bet') then 'bet' when contains(lower(props), 'allin') then 'allin' else 'unknown' end as decision from (select event_id, concat(props, case event_id % 4 when 0 then ' I CALL, not fold' when 1 then ' raise' when 2 then ' allin' else '' end) as props from events)")
def fn_extract_decision(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = F.concat("props", F.expr("case event_id % 4 when 0 then ' I CALL, not fold' when 1 then ' raise' when 2 then ' allin' else '' end"))
    return e.select("event_id", prompts.keyword_decision(text).alias("decision"))


@query("fn_enforce_structured", "select event_id, case event_id % 2 when 0 then concat('x', chr(10), chr(10), '### Action', chr(10), 'RAISE 8 BB') else concat('plain', chr(10), chr(10), '### Action', chr(10), 'RAISE 8 BB') end as t from events")
def fn_enforce_structured(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = F.expr("case event_id % 2 when 0 then 'x\\n\\n### Action\\nFOLD' else 'plain' end")
    return e.select("event_id", prompts.enforce_structured(text, F.lit("raise 8bb")).alias("t"))


@query("fn_labeler_prompt", RAW + "select source_index, concat('Situation:', chr(10), trim(instruction), chr(10), chr(10), 'Gold action (from the solver): fold', chr(10), chr(10), 'Write the reasoning trace, ending with ''Decision: fold''.') as text from raw")
def fn_labeler_prompt(spark, sf):
    return _raw(spark, sf).select("source_index", prompts.labeler_prompt(F.col("instruction"), F.lit("fold")).alias("text"))


@query("fn_student_content", RAW + "select source_index, concat('Because.', chr(10), 'Decision: fold', chr(10), 'Decision: fold') as text from raw")
def fn_student_content(spark, sf):
    """The concise form adds its decision line to a text that has one."""
    return _raw(spark, sf).select("source_index", prompts.student_content(F.lit("Because.\nDecision: fold"), F.lit("fold")).alias("text"))


@query("fn_sql_scalars", RAW + "select source_index, substr(instruction, 1, 10) || '...' as head, coalesce(correct_decision, 'none') as label from raw")
def fn_sql_scalars(spark, sf):
    return spark.sql("select source_index, substr(instruction, 1, 10) || '...' as head, coalesce(correct_decision, 'none') as label from {r}", r=_raw(spark, sf))


_SEQ = ", p as (select source_index, i, a, b, contains(lower(a), 'bb') as sized from toks where i % 2 = 1 and a is not null), q as (select *, sum(cast(sized as int)) over (partition by source_index order by i) as k from p), s as (select source_index, i, case when not sized then a when k = 1 then 'bet' else 'raise' end as t from q)\n"


@query("fn_legacy_counts", duck.with_(duck.RAW, duck.EVENTS).rstrip() + _SEQ + "select raw.source_index, count(t)::int as num_actions, " + ", ".join(f"(count(*) filter (where t = '{k}'))::int as num_{k}" for k in ("fold", "call", "bet", "raise", "allin")) + " from raw left join s using (source_index) group by 1")
def fn_legacy_counts(spark, sf):
    return _raw(spark, sf).select("source_index", *[c.alias(n) for n, c in features.legacy_counts(lines.legacy_actions(F.col("prev_line"))).items()])


@query("fn_legacy_action_encoding", duck.with_(duck.RAW, duck.EVENTS).rstrip() + _SEQ + """, c as (select raw.source_index, count(t)::int as n, (count(*) filter (where t = 'fold'))::int as f, (count(*) filter (where t = 'call'))::int as c, (count(*) filter (where t in ('bet', 'raise')))::int as r, (count(*) filter (where t = 'allin'))::int as a, arg_max(t, i) as last from raw left join s using (source_index) group by 1)
select source_index, n as action_count, f as fold_count, c as call_count, r as raise_count, a as allin_count, least(10.0e0, case when c > 0 then (r + a) / c::double else (r + a)::double end) as aggression_factor,
  case last when 'fold' then 0 when 'check' then 1 when 'call' then 2 when 'bet' then 3 when 'raise' then 4 when 'allin' then 5 else -1 end as last_action_type, 0.0e0 as last_action_amount from c""")
def fn_legacy_action_encoding(spark, sf):
    made = features.legacy_actions(lines.legacy_actions(F.col("prev_line")), F.array().cast("array<double>"))
    return _raw(spark, sf).select("source_index", *[c.alias(n) for n, c in made.items()])


@query("fn_legacy_position", RAW + ", x as (select *, case hero_pos when 'UTG' then 0 when 'HJ' then 1 when 'CO' then 2 when 'BTN' then 3 when 'SB' then 4 else 5 end as i from raw) select source_index, i as position_idx, (i <= 1)::int as is_early_position, (i = 2)::int as is_middle_position, (i = 3)::int as is_late_position, (i >= 4)::int as is_blind, (i + 1) / 6.0e0 as position_strength, i / num_players::double as relative_position from x")
def fn_legacy_position(spark, sf):
    return _raw(spark, sf).select("source_index", *[c.alias(n) for n, c in features.legacy_position(F.col("hero_pos"), F.col("num_players")).items()])


@query("fn_legacy_pot", RAW + ", x as (select source_index, pot_size as p, 5 * pot_size as s, num_bets::double as b from raw) select source_index, least(50.0e0, s / p) as spr, p / s as pot_to_stack_ratio, (s / p < 3)::int as is_low_spr, (s / p between 3 and 8)::int as is_medium_spr, (s / p > 8)::int as is_high_spr, b / p as last_bet_to_pot, case when b > 0 then p / (p + b) else 0 end as pot_odds from x")
def fn_legacy_pot(spark, sf):
    return _raw(spark, sf).select("source_index", *[c.alias(n) for n, c in features.legacy_pot_features(F.col("pot_size"), 5 * F.col("pot_size"), F.col("num_bets").cast("double")).items()])


query("fn_spr_legacy", RAW + "select source_index, case when pot_size > 0 then 5.0e0 else 999.0e0 end as spr from raw")(lambda spark, sf: _raw(spark, sf).select("source_index", features.legacy_pot(F.col("pot_size"), F.lit(1.0))["spr_legacy"].alias("spr")))


# Windows over events.
@query("win_first_per_pos", duck.with_(duck.RAW, duck.EVENTS) + "select source_index, position, arg_min(action, seq) as action from ev group by 1, 2")
def win_first_per_pos(spark, sf):
    one = _ev(spark, sf).select("source_index", F.posexplode("events").alias("i", "e"))
    return one.groupBy("source_index", F.col("e.position").alias("position")).agg(F.min_by("e.action", "i").alias("action"))


@query("win_prior_raise", duck.with_(duck.RAW, duck.EVENTS) + "select source_index, seq, coalesce(max((action in ('raise', 'allin'))::int) over (partition by split, source_index order by seq rows between unbounded preceding and 1 preceding), 0) as raised from ev")
def win_prior_raise(spark, sf):
    """Whether somebody raised before each event; worked out inside the row, so nothing is shuffled."""
    e = F.col("events")
    flags = F.transform(e, lambda x, i: F.struct(i.cast("long").alias("seq"), F.exists(F.slice(e, 1, i), lambda y: y["action"].isin(*lines.AGGRESSIVE)).cast("int").alias("raised")))
    return _ev(spark, sf).select("source_index", F.explode(flags).alias("x")).select("source_index", "x.*")


@query("agg_active_opponents", duck.with_(duck.RAW, duck.EVENTS) + ", l as (select source_index, position, arg_max(action, seq) as a from ev where position <> hero_pos group by 1, 2), n as (select source_index, count(*) filter (where a <> 'fold') as n from l group by 1) select coalesce(n, 0)::int as active, count(*) as hands from raw left join n using (source_index) group by 1")
def agg_active_opponents(spark, sf):
    return _ev(spark, sf).groupBy(lines.active_opponents(F.col("events"), F.col("hero_pos")).alias("active")).agg(F.count("*").alias("hands"))


@query("fn_render_street", duck.DECISION + "select hand_id, street, string_agg(position || '/' || action, '/' order by decision_id) as line from dec where action <> 'raise' and action <> 'allin' group by 1, 2")
def fn_render_street(spark, sf):
    d = bridge.decisions(spark, sf).where("action not in ('raise', 'allin')")
    return spark.sql("select hand_id, street, listagg(position || '/' || action, '/') within group (order by decision_id) as line from {d} group by 1, 2", d=d)


# Joins.
@query("join_using", duck.BASE + "select situation_id, count(*) as n, max(amount) as top from sit join ev using (split, source_index) group by 1")
def join_using(spark, sf):
    t = promptdb.build(_raw(spark, sf))
    return t["situations"].select("situation_id").join(t["situation_actions"], "situation_id").groupBy("situation_id").agg(F.count("*").alias("n"), F.max("size_bb").alias("top"))


@query("join_template", RAW + "select source_index, cast(1 as bigint) as template_id from raw")
def join_template(spark, sf):
    place = _place(spark, "shells")  # texts are masked once: the few shells take next to nothing in a column file
    promptdb.parsed(_raw(spark, sf)).select("split", "source_index", "template_hash", "shell").write.parquet(place)
    df = spark.read.parquet(place)
    t = promptdb.templates(df).select("template_id", "template_hash")
    return df.select("source_index", "template_hash").join(F.broadcast(t), "template_hash").select("source_index", "template_id")


@query("join_positional", RAW + ", a as (select row_number() over (order by source_index) - 1 as i, hero_pos, hero_holding from raw) select i as source_index, hero_pos, hero_holding from a")
def join_positional(spark, sf):
    """Two tables written by row and zipped by place."""
    place = _place(spark, "rows")
    raw = _raw(spark, sf).orderBy("source_index").select("hero_pos", "hero_holding")
    raw.select("hero_pos").write.parquet(f"{place}/a")
    raw.select("hero_holding").write.parquet(f"{place}/b")
    return readers.zip_rows(spark.read.parquet(f"{place}/a"), spark.read.parquet(f"{place}/b"))


@query("join_aggressor_stats", duck.with_(duck.RAW, duck.EVENTS) + ", n as (select position, count(*) as actions from ev group by 1), o as (select source_index, arg_max(position, seq) as position from ev where action in ('raise', 'allin') and position <> hero_pos group by 1) select raw.source_index, coalesce(actions, 0) as actions from raw left join o using (source_index) left join n using (position)")
def join_aggressor_stats(spark, sf):
    ev = _ev(spark, sf)
    n = ev.select(F.explode("events.position").alias("position")).groupBy("position").agg(F.count("*").alias("actions"))
    return ev.select("source_index", lines.last_aggressor(F.col("events"), F.col("hero_pos")).alias("position")).join(F.broadcast(n), "position", "left").select("source_index", F.coalesce("actions", F.lit(0)).alias("actions"))


@query("join_proba_hstack", duck.PRED + "select event_id, p0 as a0, p1 as a1, p2 as a2, p2 as b0, p0 as b1, p1 as b2 from pred")
def join_proba_hstack(spark, sf):
    """The probabilities of two models side by side, by key."""
    a = bridge.predictions(spark, sf).select("event_id", F.col("p0").alias("a0"), F.col("p1").alias("a1"), F.col("p2").alias("a2"))
    b = bridge.predictions(spark, sf).select("event_id", F.col("p2").alias("b0"), F.col("p0").alias("b1"), F.col("p1").alias("b2"))
    return a.join(b, "event_id")


# Metrics and trajectories.
query("agg_top2_accuracy", _PRED + "select avg(((p0 > p_true or (p0 = p_true and 0 > y))::int + (p1 > p_true or (p1 = p_true and 1 > y))::int + (p2 > p_true or (p2 = p_true and 2 > y))::int < 2)::int) as top2 from s")(lambda spark, sf: _pred(spark, sf).agg(F.avg((F.col("true_rank") <= 2).cast("int")).alias("top2")))
query("fn_correctness", _PRED + "select event_id, (pred = y)::int as correct from s")(lambda spark, sf: _pred(spark, sf).select("event_id", "correct"))
query("fn_top1_margin", _PRED + "select event_id, round(abs(p_max - (p0 + p1 + p2 - p_max - least(p0, p1, p2))), 9) as margin from s")(lambda spark, sf: _pred(spark, sf).select("event_id", F.round("margin", 9).alias("margin")))
query("fn_bluff_ev", duck.PRED + "select event_id, villain_p * pot - (1 - villain_p) * bet as ev from pred")(lambda spark, sf: bridge.predictions(spark, sf).select("event_id", metrics.bluff_ev(F.col("villain_p"), F.col("pot"), F.col("bet")).alias("ev")))
query("fil_loop_combo", duck.DECISION + "select decision_id from dec where reward_bb > 0 and showdown")(lambda spark, sf: rewards.keep(bridge.decisions(spark, sf), True, True).select("decision_id"))
query("fil_nonempty_pair", RAW + "select source_index from raw where trim(coalesce(correct_decision, '')) <> '' and trim(instruction) <> ''")(lambda spark, sf: _raw(spark, sf).where("trim(correct_decision) <> '' and trim(instruction) <> ''").select("source_index"))
query("sim_rewards", duck.DECISION + ", m as (select position, avg(reward_bb) as m from dec where reward_bb > 0 group by 1) select decision_id, round(reward_bb - m, 9) as advantage from dec join m using (position) where reward_bb > 0")(lambda spark, sf: rewards.advantage(rewards.winners(bridge.decisions(spark, sf))).select("decision_id", F.round("advantage", 9).alias("advantage")))
query("sim_blinds", "select o_orderkey, least(1.0e0, (o_custkey % 3) * 0.5e0) as pay, (o_custkey % 3) * 0.5e0 - least(1.0e0, (o_custkey % 3) * 0.5e0) = 0 as all_in from orders")(lambda spark, sf: spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.least(F.lit(1.0), (F.col("o_custkey") % 3) * 0.5).alias("pay"), ((F.col("o_custkey") % 3) * 0.5 - F.least(F.lit(1.0), (F.col("o_custkey") % 3) * 0.5) == 0).alias("all_in")))
_NETS = ", nets as (select hand_id, seat_id, sum(reward_bb) as net from dec where seat_id <> 4 group by 1, 2), tops as (select hand_id, arg_max(seat_id, (net, -seat_id)) as top from nets group by 1)"


@query("prj_decision_reward", duck.DECISION + _NETS + " select decision_id, coalesce(net, 0) as reward_bb, coalesce(dec.seat_id = top, false) as winner, case when action = 'raise' then concat('raise ', rtrim(rtrim(printf('%.3f', amount_bb), '0'), '.'), 'bb') else action end as output from dec left join nets on nets.hand_id = dec.hand_id and nets.seat_id = dec.seat_id left join tops on tops.hand_id = dec.hand_id")
def prj_decision_reward(spark, sf):
    """Each decision with its seat's reward, whether the seat won the hand, and the decision as text; seat 4 is missing in the hands' maps and has 0."""
    dec = bridge.decisions(spark, sf)
    nets = dec.where("seat_id <> 4").groupBy("hand_id", "seat_id").agg(F.sum("reward_bb").alias("net"))
    # At most six seats a hand, so the lists are bounded.
    hands = nets.groupBy("hand_id").agg(F.map_from_entries(F.collect_list(F.struct("seat_id", "net"))).alias("net_deltas"), F.array(F.max(F.struct("net", (-F.col("seat_id")).alias("minus"), "seat_id"))["seat_id"]).alias("winners"))
    return rewards.attach(dec, hands).select("decision_id", "reward_bb", "winner", "output")


query("prj_label_col", duck.BASE + "select source_index, canonical_label as _label from sit")(lambda spark, sf: _raw(spark, sf).select("source_index", labels.canonical(F.col("correct_decision")).alias("_label")))
query("prj_col_overwrite_merge", RAW + "select source_index, pot_size * 2 as pot_size, hero_pos from raw")(lambda spark, sf: features.overwrite_merge(_raw(spark, sf).select("source_index", "pot_size", "hero_pos"), {"pot_size": F.col("pot_size") * 2}))
query("set_union_sft", RAW + ", d as (select distinct 1) select 'real' as kind, count(*) as n from raw group by 1 union all select 'synthetic', count(*) from events")(lambda spark, sf: _raw(spark, sf).select(F.lit("real").alias("kind")).unionByName(bridge.decisions(spark, sf).select(F.lit("synthetic").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n")))


@query("prj_numeric_features", "select unnest(['event_id', 'reward_bb', 'seat_id', 'value', 'amount_bb', 'decision_id', 'hand_id']) as name except select 'event_id'")
def prj_numeric_features(spark, sf):
    d = bridge.decisions(spark, sf)
    return spark.createDataFrame([(c,) for c in features.numeric_columns(d)], "name string")


# Files there and back.
def _back(name: str, oracle: str):
    """Register a query that writes decisions with a sink and reads them again."""
    return query(name, duck.DECISION + oracle)


@_back("src_decisions_jsonl", "select decision_id, action, reward_bb from dec")
def src_decisions_jsonl(spark, sf):
    place = _place(spark, "decisions")
    bridge.decisions(spark, sf).write.json(place)
    return spark.read.schema("decision_id long, action string, reward_bb double").json(place)


@_back("snk_traj_jsonl", "select decision_id, action from dec where reward_bb > 1")
def snk_traj_jsonl(spark, sf):
    place = _place(spark, "traj")
    d = bridge.decisions(spark, sf)
    sinks.trajectories_jsonl(d, d.select("hand_id").distinct(), place, with_reward=False, condition=F.col("reward_bb") > 1)
    return spark.read.schema("decision_id long, action string").json(place)


@_back("snk_samples_jsonl", "select decision_id, position from dec")
def snk_samples_jsonl(spark, sf):
    place = _place(spark, "samples")
    sinks.samples_jsonl(bridge.decisions(spark, sf).withColumn("raw", F.lit("x")), place)
    assert "raw" not in spark.read.json(place).columns
    return spark.read.schema("decision_id long, position string").json(place)


@query("src_sample_jsonl", RAW + "select source_index, hero_pos, pot_size as pot from raw")
def src_sample_jsonl(spark, sf):
    place = _place(spark, "samples")
    sinks.samples_jsonl(features.samples(_raw(spark, sf)), place)
    back = spark.read.schema("source_index long, hero_pos string, hero_hole string, num_players int, num_bets int, pot double, stack double").json(place)
    return back.where(features.reject_reason(F.col("hero_pos")).isNull()).select("source_index", "hero_pos", "pot")


@query("snk_legacy_dual", RAW + "select source_index, source_index % 5 as kind from raw")
def snk_legacy_dual(spark, sf):
    place = _place(spark, "dual")
    df = features.samples(_raw(spark, sf)).select("source_index", "moves", (F.col("source_index") % 5).alias("kind"))
    sinks.legacy_dual(df, place)
    csv = spark.read.option("header", True).option("escape", '"').schema("source_index long, moves string, kind long").csv(f"{place}/csv")
    both = csv.join(spark.read.parquet(f"{place}/parquet").withColumnRenamed("moves", "list").drop("kind"), "source_index")
    return both.where("moves = to_json(list)").select("source_index", "kind")


@query("src_legacy_csv", RAW + "select hero_pos, count(*) as n from raw group by 1")
def src_legacy_csv(spark, sf):
    place = _place(spark, "legacy")
    _raw(spark, sf).select("hero_pos", "pot_size").write.option("header", True).csv(place)
    return spark.read.option("header", True).schema("hero_pos string, pot_size double").csv(place).groupBy("hero_pos").agg(F.count("*").alias("n"))


@query("src_download_alias", RAW + "select hero_pos, pot_size from raw")
def src_download_alias(spark, sf):
    """A table with index columns that a writer added; they are left out."""
    place = _place(spark, "unnamed")
    _raw(spark, sf).select(F.col("source_index").alias("Unnamed: 0"), "hero_pos", "pot_size").write.parquet(place)
    return readers.drop_unnamed(spark.read.parquet(place))


@query("snk_feature_parquet", duck.BASE + "select source_index, canonical_label as _label from sit")
def snk_feature_parquet(spark, sf):
    place = _place(spark, "features")
    sinks.features_parquet(features.features(features.samples(_raw(spark, sf)), single=True), place)
    return spark.read.parquet(place).select("source_index", "_label")


@query("lim_render", RAW + "select source_index, hero_pos from raw order by source_index limit 50")
def lim_render(spark, sf):
    return _raw(spark, sf).select("source_index", "hero_pos").orderBy("source_index").limit(50)


@query("src_catalog_tables", "select 'situations' as name union all select 'situation_actions'")
def src_catalog_tables(spark, sf):
    """Views of the current catalog, by name."""
    t = promptdb.build(_raw(spark, sf))
    for name in ("situations", "situation_actions"):
        t[name].createOrReplaceTempView(name)
    names = [(x.name,) for x in spark.catalog.listTables() if x.name in ("situations", "situation_actions")]
    return spark.createDataFrame(names, "name string")


@query("stm_generator_sources", "select event_type, count(*) as n from events group by 1")
def stm_generator_sources(spark, sf):
    """A folder of JSON lines read as a stream to its end."""
    place = _place(spark, "stream")
    spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type").write.json(f"{place}/in")
    stream = spark.readStream.schema("event_id long, event_type string").option("maxFilesPerTrigger", 1).json(f"{place}/in")
    stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/out").groupBy("event_type").agg(F.count("*").alias("n"))
