"""Queries over trajectories, hands and side pots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cards, lines, prompts
from ..operators import rewards
from ..sources import bridge
from ..sources.shared import tasks_for
from . import duck
from .registry import query


def _dec(spark, sf):
    return bridge.decisions(spark, sf)


@query("fil_winners", duck.DECISION + "select decision_id, reward_bb from dec where reward_bb > 0")
def fil_winners(spark, sf):
    return rewards.winners(_dec(spark, sf)).select("decision_id", "reward_bb")


@query("fil_showdown", duck.DECISION + "select decision_id from dec where showdown")
def fil_showdown(spark, sf):
    return rewards.showdowns(_dec(spark, sf)).select("decision_id")


@query("fil_positive_ev", duck.DECISION + "select decision_id from dec where reward_bb > 2.5")
def fil_positive_ev(spark, sf):
    return rewards.positive_ev(_dec(spark, sf), 2.5).select("decision_id")


@query("fil_min_reward", duck.DECISION + "select decision_id from dec where reward_bb > 0 and showdown and reward_bb >= 5")
def fil_min_reward(spark, sf):
    return rewards.keep(_dec(spark, sf), True, True, 5.0).select("decision_id")


@query("fil_policy_synthetic", duck.DECISION + "select decision_id from dec where seat_id = 0 and reward_bb > 0 and street = 'preflop'")
def fil_policy_synthetic(spark, sf):
    return _dec(spark, sf).where("seat_id = 0 and reward_bb > 0 and street = 'preflop'").select("decision_id")


@query("join_pos_baseline", duck.DECISION + ", m as (select position, avg(reward_bb) as m from dec group by 1) select decision_id, round(reward_bb - m, 9) as advantage from dec join m using (position)")
def join_pos_baseline(spark, sf):
    return rewards.advantage(_dec(spark, sf)).select("decision_id", F.round("advantage", 9).alias("advantage"))


@query("agg_selfplay_summary", duck.DECISION + "select count(distinct hand_id) as hands, count(*) as decisions, avg(cast(showdown as int)) as showdown_share, sum(reward_bb) as total, abs(sum(reward_bb)) as leak from dec")
def agg_selfplay_summary(spark, sf):
    return rewards.summary(_dec(spark, sf))


_HANDS = ", hands as (select hand_id, seat_id, sum(reward_bb) as net from dec group by 1, 2)"


@query("join_seat_reward", duck.DECISION + _HANDS + "select decision_id, coalesce(net, 0) as reward_bb, coalesce(net, 0) > 0 as winner, case when action = 'raise' then concat('raise ', rtrim(rtrim(printf('%.3f', amount_bb), '0'), '.'), 'bb') else action end as output from dec left join (select * from hands where seat_id < 5) h using (hand_id, seat_id)")
def join_seat_reward(spark, sf):
    """Results of hands as maps from seats to nets; seat 5 is missing, so it has 0."""
    dec = _dec(spark, sf)
    nets = dec.where("seat_id < 5").groupBy("hand_id", "seat_id").agg(F.sum("reward_bb").alias("net"))
    # At most six seats a hand, so the lists are bounded.
    hands = nets.groupBy("hand_id").agg(F.map_from_entries(F.collect_list(F.struct("seat_id", "net"))).alias("net_deltas"), F.collect_list(F.when(F.col("net") > 0, F.col("seat_id"))).alias("winners"))
    return rewards.attach(dec, hands).select("decision_id", "reward_bb", "winner", "output")


_SEATS = """
seats as (select l_orderkey as hand_id, cast(l_suppkey % 6 as int) as seat_id, sum(l_quantity) as paid, min(l_partkey % 4) = 0 as folded, max(l_suppkey * 7 % 13) as points from lineitem group by 1, 2),
tiers as (select distinct hand_id, paid as tier from seats where paid > 0), steps as (select hand_id, tier, coalesce(lag(tier) over (partition by hand_id order by tier), 0) as below from tiers),
pots as (select hand_id, tier, sum(greatest(least(paid, tier) - below, 0)) as amount, count(*) filter (where paid >= tier and not folded) as n_eligible, max(points) filter (where paid >= tier and not folded) as best from steps join seats using (hand_id) group by 1, 2)
"""


def _seats(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    line = line.repartition(tasks_for(line), "l_orderkey")  # by hand, for all that follows, in parts that don't grow with the table
    return line.groupBy(F.col("l_orderkey").alias("hand_id"), (F.col("l_suppkey") % 6).cast("int").alias("seat_id")).agg(F.sum("l_quantity").alias("paid"), (F.min(F.col("l_partkey") % 4) == 0).alias("folded"), F.array(F.max(F.col("l_suppkey") * 7 % 13).cast("int")).alias("score"))


@query("sim_side_pots", f"with {_SEATS} select hand_id, tier, amount, n_eligible, cast(best as int) as best from pots where amount > 1e-9 and n_eligible > 0")
def sim_side_pots(spark, sf):
    return rewards.side_pots(_seats(spark, sf)).select("hand_id", "tier", "amount", "n_eligible", F.get("best", F.lit(0)).alias("best"))


@query("set_pot_tiers", f"with {_SEATS} select hand_id, count(*) as n_tiers, max(tier) as top from tiers group by 1")
def set_pot_tiers(spark, sf):
    return _seats(spark, sf).where("paid > 0").groupBy("hand_id").agg(F.countDistinct("paid").alias("n_tiers"), F.max("paid").alias("top"))


@query("sim_settle", f"with {_SEATS}, w as (select hand_id, tier, amount, seat_id, count(*) over (partition by hand_id, tier) as k from pots join seats using (hand_id) where amount > 1e-9 and n_eligible > 0 and paid >= tier and not folded and points = best), g as (select hand_id, seat_id, sum(amount / k) as gain from w group by 1, 2) select hand_id, seat_id, round(coalesce(gain, 0) - paid, 6) as delta from seats left join g using (hand_id, seat_id)")
def sim_settle(spark, sf):
    return rewards.settle(_seats(spark, sf)).select("hand_id", "seat_id", F.round("delta", 6).alias("delta"))


@query("sim_positions", "select o_orderkey, case (o_orderkey % 6 - o_custkey % 6 + 6) % 6 when 0 then 'BTN' when 1 then 'SB' when 2 then 'BB' when 3 then 'UTG' when 4 then 'HJ' else 'CO' end as position from orders")
def sim_positions(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", rewards.seat_position(F.col("o_orderkey") % 6, F.col("o_custkey") % 6, 6).alias("position"))


_LEGAL = """with x as (select o_orderkey, (o_orderkey % 17) * 0.5e0 as cur, (o_orderkey % 5) * 0.5e0 as put, (o_custkey % 23) * 1.0e0 as stack from orders), y as (select *, greatest(cur - put, 0) as owed, put + stack as most from x)
select o_orderkey, owed <= 1e-9 as can_check, case when owed > 1e-9 then least(owed, stack) end as call, case when most > cur + 1e-9 and stack > 0 then least(cur + 1.0e0, most) end as raise_min, case when most > cur + 1e-9 and stack > 0 then most end as raise_max, case when stack > 0 then most end as allin from y"""


@query("sim_legal_actions", _LEGAL)
def sim_legal_actions(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    legal = rewards.legal_actions((F.col("o_orderkey") % 17) * 0.5, (F.col("o_orderkey") % 5) * 0.5, (F.col("o_custkey") % 23) * 1.0, F.lit(1.0), F.lit(1.0))
    return o.select("o_orderkey", legal.alias("l")).select("o_orderkey", F.col("l.check").alias("can_check"), "l.call", "l.raise_min", "l.raise_max", "l.allin")


@query("win_cum_stack", "select l_orderkey, seq, sum(q) over (partition by l_orderkey order by seq) as pot_after, 100 - sum(q) over (partition by l_orderkey, seat order by seq) as stack_after from (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as seq, l_suppkey % 6 as seat, l_quantity as q from lineitem)")
def win_cum_stack(spark, sf):
    from pyspark.sql import Window

    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")).cast("long")
    acts = line.select(F.col("l_orderkey").alias("hand_id"), seq.alias("seq"), (F.col("l_suppkey") % 6).alias("seat_id"), F.col("l_quantity").alias("paid"))
    return rewards.replay(acts).select(F.col("hand_id").alias("l_orderkey"), "seq", "pot_after", "stack_after")


_SCORE = f"""with c as ({bridge.SEVEN}), r as (select o_orderkey, c % 13 + 2 as r, (c - c % 13) // 13 as s from c),
g as (select o_orderkey, r, count(*) as n from r group by 1, 2), o as (select o_orderkey, r, n, row_number() over (partition by o_orderkey order by n desc, r desc) as k from g),
top as (select o_orderkey, max(n) filter (where k = 1) as n0, max(n) filter (where k = 2) as n1, max(r) filter (where k = 1) as r0 from o group by 1),
fl as (select o_orderkey, s from r group by 1, 2 having count(*) >= 5), low as (select o_orderkey, r from g union select o_orderkey, 1 from g where r = 14),
run as (select a.o_orderkey, max(a.r) as hi from low a where (select count(*) from low b where b.o_orderkey = a.o_orderkey and b.r between a.r - 4 and a.r) = 5 group by 1),
fr as (select r.o_orderkey, r.r from r join fl using (o_orderkey, s)), flow as (select * from fr union select o_orderkey, 1 from fr where r = 14),
frun as (select a.o_orderkey, max(a.r) as hi from flow a where (select count(*) from flow b where b.o_orderkey = a.o_orderkey and b.r between a.r - 4 and a.r) = 5 group by 1),
ls as (select o_orderkey, list(r order by r desc) as l, list(r order by r desc) filter (where n >= 2) as twos, max(r) filter (where k = 2) as r1 from o group by 1), fls as (select o_orderkey, list(r order by r desc) as same from fr group by 1)
select t.o_orderkey, array_to_string(case when frun.hi is not null then [frun.hi] when n0 >= 4 then list_concat([r0], list_filter(l, lambda x: x <> r0)[1:1]) when n0 = 3 and n1 >= 2 then [r0, list_filter(twos, lambda x: x <> r0)[1]] when fl.s is not null then same[1:5] when run.hi is not null then [run.hi]
  when n0 = 3 then list_concat([r0], list_filter(l, lambda x: x <> r0)[1:2]) when n0 = 2 and n1 = 2 then list_concat([r0, r1], list_filter(l, lambda x: x <> r0 and x <> r1)[1:1]) when n0 = 2 then list_concat([r0], list_filter(l, lambda x: x <> r0)[1:3]) else l[1:5] end, ',') as ranks, case when frun.hi is not null then 'straight_flush' when n0 >= 4 then 'quads' when n0 = 3 and n1 >= 2 then 'full_house' when fl.s is not null then 'flush' when run.hi is not null then 'straight' when n0 = 3 then 'trips' when n0 = 2 and n1 = 2 then 'two_pair' when n0 = 2 then 'pair' else 'high_card' end as category
from top t join ls using (o_orderkey) left join fl using (o_orderkey) left join fls using (o_orderkey) left join run using (o_orderkey) left join frun using (o_orderkey)"""


@query("fn_hand_score_7", _SCORE)
def fn_hand_score_7(spark, sf):
    """Seven cards of a hand are gathered (a fixed number), scored on their histograms and named."""
    c = bridge.seven_cards(spark, sf)
    card = F.concat(F.substring(F.lit(cards.RANKS), (F.col("c") % 13 + 1).cast("int"), F.lit(1)), F.substring(F.lit(cards.SUITS), (F.floor(F.col("c") / 13) + 1).cast("int"), F.lit(1)))
    hands = c.groupBy("o_orderkey").agg(F.collect_list(card).alias("cards"))
    return cards.with_score(hands, "cards").select("o_orderkey", cards.category(F.col("score")).alias("category"), F.array_join(F.slice("score", 2, 5), ",").alias("ranks"))


_RULE = duck.with_(duck.RAW, duck.EVENTS, duck.COUNTS, duck.HANDS) + """, x as (
  select chen.source_index, chen.hero_pos, chen.chen as s, pot_size as pot, coalesce(max_bet, 0) as b, greatest(coalesce(max_bet, 0) - 0.5e0, 0) as owed, chen.hero_pos in ('BTN', 'CO', 'HJ') as late, chen.hero_pos in ('SB', 'BB') as blind
  from chen join raw using (split, source_index) left join cnt using (split, source_index)),
y as (select *, owed <= 1e-9 as can_check, 100.5e0 > b + 1e-9 as can_raise, case when owed > 1e-9 then least(owed, 100.0e0) else 0 end as to_call from x),
z as (select *, case when s >= 9 and can_raise then 'strong' when s >= 9 and to_call > pot * 2 then 'allin' when s >= 6 and can_raise and (late or to_call <= 1) then 'open' when s >= 6 and not can_check and to_call <= 5 then 'call'
  when s >= 4 and can_check then 'check' when s >= 4 and not can_check and to_call <= 2 and (blind or late) then 'call' when can_check then 'check' else 'fold' end as k from y)
select source_index, case when k in ('strong', 'open') then 'raise' else k end as kind, case when k = 'strong' then round(least(100.5e0, greatest(least(b + 1.0e0, 100.5e0), pot * 3.0e0)), 2) when k = 'open' then round(least(100.5e0, greatest(least(b + 1.0e0, 100.5e0), pot * 2.5e0)), 2) end as amount_bb from z"""


@query("sim_player_heuristic", _RULE)
def sim_player_heuristic(spark, sf):
    raw = bridge.scenarios(spark, sf)
    legal = rewards.legal_actions(lines.facing_bet(lines.events(F.col("prev_line"))), F.lit(0.5), F.lit(100.0), F.lit(1.0), F.lit(1.0))
    df = raw.select("source_index", "hero_pos", "hero_holding", "pot_size", legal.alias("legal"))
    act = rewards.preflop_rule(F.col("hero_holding"), F.col("hero_pos"), F.col("legal"), F.coalesce("legal.call", F.lit(0.0)), F.col("pot_size"))
    return df.select("source_index", act.alias("a")).select("source_index", "a.kind", "a.amount_bb")


_ANSWER = "case event_id % 9 when 0 then 'fold.' when 1 then 'call' when 2 then 'raise 8bb' when 3 then 'all in' when 4 then '' when 5 then 'raise 999bb' when 6 then 'raise 1' when 7 then 'I will call.' else 'bet 5bb' end"


@query("fn_parse_action", f"select event_id, case event_id % 9 when 0 then 'fold' when 1 then 'call' when 3 then 'allin' when 4 then 'fold' when 7 then 'call' else 'raise' end as kind, cast(case event_id % 9 when 2 then 8 when 5 then 50 when 6 then 3 when 8 then 5 end as double) as amount_bb from events")
def fn_parse_action(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", prompts.parse_answer(F.expr(_ANSWER), F.lit(False), F.lit(True), F.lit(3.0), F.lit(50.0), F.lit(True)).alias("a")).select("event_id", "a.kind", "a.amount_bb")


@query("fn_llm_parse", "select event_id, case event_id % 9 when 0 then 'fold' when 1 then 'call' when 2 then 'raise' when 3 then 'allin' when 4 then '' when 5 then 'raise' when 6 then 'raise' when 7 then 'call' else 'bet' end as action, case event_id % 9 when 0 then 'fold' when 1 then 'call' when 2 then 'raise' when 3 then 'unknown' when 4 then 'unknown' when 5 then 'raise' when 6 then 'raise' when 7 then 'call' else 'bet' end as keyword from events")
def fn_llm_parse(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.expr(_ANSWER).alias("t"))
    return e.select("event_id", prompts.first_action(F.col("t")).alias("action"), prompts.keyword_decision(F.col("t")).alias("keyword"))


@query("fn_canonical_action_line", "select event_id, case event_id % 9 when 0 then 'FOLD.' when 1 then 'CALL' when 2 then 'RAISE 8 BB' when 3 then 'ALLIN' when 4 then 'CHECK' when 5 then 'RAISE 999 BB' when 6 then 'RAISE 1 BB' when 7 then 'I WILL CALL.' else 'BET 5 BB' end as line from events")
def fn_canonical_action_line(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", prompts.action_line(F.expr(_ANSWER)).alias("line"))


@query("fn_enforce_decision", "select event_id, case event_id % 3 when 0 then concat('Thinking.', chr(10), 'Decision: fold') when 1 then concat('Well.', chr(10), 'Decision: fold') else concat('a', chr(10), 'Decision: x', chr(10), 'b', chr(10), 'Decision: fold') end as t from events")
def fn_enforce_decision(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = F.expr("case event_id % 3 when 0 then 'Thinking.' when 1 then 'Well.\\nDecision: call' else 'a\\nDecision: x\\nb\\n  decision : y\\nrest' end")
    return e.select("event_id", prompts.enforce_decision(text, F.lit("fold")).alias("t"))


@query("fn_format_g", "select event_id, rtrim(rtrim(printf('%.3f', (event_id % 4001) / 8.0), '0'), '.') as g from events")
def fn_format_g(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", lines.format_g((F.col("event_id") % 4001) / 8.0).alias("g"))


@query("snk_sft_from_traj", duck.DECISION + "select decision_id, concat('Street ', street) as c1, case when action = 'raise' then concat('raise ', rtrim(rtrim(printf('%.3f', amount_bb), '0'), '.'), 'bb') else action end as c2 from dec where reward_bb > 0")
def snk_sft_from_traj(spark, sf):
    d = rewards.winners(_dec(spark, sf)).select("decision_id", F.concat(F.lit("Street "), "street").alias("prompt"), prompts.format_action(F.col("action"), F.col("amount_bb")).alias("output"))
    m = prompts.messages(F.lit("s"), F.col("prompt"), F.col("output"))
    return d.select("decision_id", m.alias("m")).select("decision_id", F.get("m", F.lit(1))["content"].alias("c1"), F.get("m", F.lit(2))["content"].alias("c2"))
