"""Trajectories: rewards, filters, advantages, side pots, legal actions, and chat records made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cards, let, prompts


def attach(decisions: DataFrame, hands: DataFrame) -> DataFrame:
    """Each decision with its seat's result: hands (hand_id, net_deltas map<int,double>, winners array<int>); a missing seat has 0."""
    joined = decisions.drop("reward_bb").join(hands, "hand_id", "left")
    reward = F.coalesce(F.try_element_at("net_deltas", F.col("seat_id")), F.lit(0.0))
    return joined.withColumns({"reward_bb": reward, "winner": F.coalesce(F.array_contains("winners", F.col("seat_id")), F.lit(False)), "output": prompts.format_action(F.col("action"), F.col("amount_bb"))}).drop("net_deltas", "winners")


def winners(df: DataFrame) -> DataFrame:
    return df.where("reward_bb > 0")


def showdowns(df: DataFrame) -> DataFrame:
    return df.where("showdown")


def positive_ev(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    return df.where(F.col("reward_bb") > threshold)


def keep(df: DataFrame, only_winners: bool = False, only_showdown: bool = False, least: float | None = None) -> DataFrame:
    """Combined filter; missing rewards are 0, missing flags false; the least reward is included."""
    r, s = F.coalesce("reward_bb", F.lit(0.0)), F.coalesce("showdown", F.lit(False))
    cond = F.lit(True)
    if only_winners:
        cond = cond & (r > 0)
    if only_showdown:
        cond = cond & s
    if least is not None:
        cond = cond & (r >= least)
    return df.where(cond)


def advantage(df: DataFrame) -> DataFrame:
    """Reward less the mean reward of the position: means are pre-aggregated and joined, one row a position."""
    means = df.groupBy("position").agg(F.avg("reward_bb").alias("_mean"))
    return df.join(F.broadcast(means), "position", "left").withColumn("advantage", F.col("reward_bb") - F.col("_mean")).drop("_mean")


def summary(df: DataFrame) -> DataFrame:
    """Hands, decisions, share of showdowns, and the sum of rewards, which leaks if it isn't 0 over whole hands."""
    return df.agg(F.countDistinct("hand_id").alias("hands"), F.count("*").alias("decisions"), F.avg(F.col("showdown").cast("int")).alias("showdown_share"), F.sum("reward_bb").alias("total"), F.abs(F.sum("reward_bb")).alias("leak"))


def _hands(seats: DataFrame) -> DataFrame:
    """One row a hand with its seats, of which there are a few."""
    return seats.groupBy("hand_id").agg(F.collect_list(F.struct("seat_id", F.col("paid").cast("double").alias("paid"), "folded", "score")).alias("seats"))


def _pots(seats: Column) -> Column:
    """array<struct<tier, amount, n_eligible, best>> of a hand's seats, the lowest tier first."""

    def pot(tier: Column, below: Column) -> Column:
        may = F.filter(seats, lambda x: (x["paid"] >= tier) & ~x["folded"])
        amount = F.aggregate(seats, F.lit(0.0), lambda a, x: a + F.greatest(F.least(x["paid"], tier) - below, F.lit(0.0)))
        return F.struct(tier.alias("tier"), amount.alias("amount"), F.size(may).cast("long").alias("n_eligible"), F.array_max(F.transform(may, lambda x: x["score"])).alias("best"))

    tiers = F.array_sort(F.array_distinct(F.filter(F.transform(seats, lambda x: x["paid"]), lambda p: p > 0)))
    pots = let(tiers, lambda t: F.transform(t, lambda tier, i: pot(tier, F.coalesce(F.get(t, i - 1), F.lit(0.0)))))
    return F.filter(pots, lambda p: (p["amount"] > 1e-9) & (p["n_eligible"] > 0))


def side_pots(seats: DataFrame) -> DataFrame:
    """(hand_id, tier, amount, n_eligible, best): pots of hands whose seats (hand_id, seat_id, paid, folded, score array<int>) paid unlike amounts.

    A tier is a distinct positive payment; its pot takes from each seat what it paid between the tier before and this one; seats that
    paid the tier and have not folded may win it, and the best scores share it.  A pot nobody may win is left out.
    """
    return _hands(seats).select("hand_id", F.inline(_pots(F.col("seats"))))


def settle(seats: DataFrame) -> DataFrame:
    """(hand_id, seat_id, delta): what each seat wins from the side pots less what it paid."""
    s = F.col("seats")
    wins = lambda x, p: (x["paid"] >= p["tier"]) & ~x["folded"] & (x["score"] == p["best"])
    shared = F.transform(_pots(s), lambda p: F.struct(p["tier"].alias("tier"), p["best"].alias("best"), (p["amount"] / F.size(F.filter(s, lambda x: wins(x, p)))).alias("share")))
    gain = lambda x, pots: F.aggregate(pots, F.lit(0.0), lambda a, p: a + F.when(wins(x, p), p["share"]).otherwise(0.0))
    each = let(shared, lambda pots: F.transform(s, lambda x: F.struct(x["seat_id"].alias("seat_id"), (gain(x, pots) - x["paid"]).alias("delta"))))
    return _hands(seats).select("hand_id", F.inline(each))


def fold_win(seats: DataFrame) -> DataFrame:
    """The same for hands that ended because all but one folded: the survivor takes all."""
    pot = seats.groupBy("hand_id").agg(F.sum("paid").alias("pot"))
    return seats.join(pot, "hand_id").select("hand_id", "seat_id", (F.when(~F.col("folded"), F.col("pot")).otherwise(0.0) - F.col("paid")).alias("delta"))


#: Labels of the seats in order, by number of players (fixed values).
SEATS = {
    2: "SB BB", 3: "BTN SB BB", 4: "CO BTN SB BB", 5: "HJ CO BTN SB BB", 6: "UTG HJ CO BTN SB BB",
    7: "UTG UTG+1 HJ CO BTN SB BB", 8: "UTG UTG+1 MP HJ CO BTN SB BB", 9: "UTG UTG+1 MP LJ HJ CO BTN SB BB",
}


def seat_position(seat: Column, button: Column, seats: int) -> Column:
    """The label of a seat for 2 to 9 players, counted from the button; heads-up the button is the small blind."""
    labels = SEATS[seats].split()
    button_at = labels.index("BTN") if "BTN" in labels else 0
    return F.get(F.array(*[F.lit(x) for x in labels]), F.pmod(seat - button + button_at, F.lit(seats)).cast("int"))


def legal_actions(current: Column, put: Column, stack: Column, min_raise: Column, big_blind: Column) -> Column:
    """struct<fold, check, call, raise_min, raise_max, allin> of a seat that has ``put`` this street and has ``stack`` left."""
    owed = F.greatest(current - put, F.lit(0.0))
    most = put + stack
    least = F.least(current + F.greatest(min_raise, big_blind), most)
    can_raise = (most > current + 1e-9) & (stack > 0)
    return F.struct(
        F.lit(True).alias("fold"),
        (owed <= 1e-9).alias("check"),
        F.when(owed > 1e-9, F.least(owed, stack)).alias("call"),
        F.when(can_raise, F.round(least, 6)).alias("raise_min"),
        F.when(can_raise, F.round(most, 6)).alias("raise_max"),
        F.when(stack > 0, F.round(most, 6)).alias("allin"),
    )


def replay(actions: DataFrame, start: float = 100.0) -> DataFrame:
    """Pot and stack after every action of recorded hands (hand_id, seq, seat_id, paid)."""
    w = Window.partitionBy("hand_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    mine = Window.partitionBy("hand_id", "seat_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return actions.withColumns({"pot_after": F.sum("paid").over(w), "stack_after": F.lit(start) - F.sum("paid").over(mine)})


def preflop_rule(hole: Column, position: Column, legal: Column, to_call: Column, pot: Column, aggression: float = 1.0, looseness: float = 1.0, size: float = 3.0) -> Column:
    """struct<kind, amount_bb> of the rule-based player before the flop, from the hand's Chen score and what is legal."""
    strength = cards.chen(hole) + (looseness - 1.0) * 2.0
    late, blind = position.isin("BTN", "CO", "HJ"), position.isin("SB", "BB")
    can_raise, can_call, check = legal["raise_min"].isNotNull(), legal["call"].isNotNull(), legal["check"]
    strong, playable, marginal = strength >= 9, strength >= 6, strength >= 4
    to = lambda times: F.round(F.least(legal["raise_max"], F.greatest(legal["raise_min"], pot * times * aggression)), 2)
    opens = playable & can_raise & (late | (to_call <= 1))
    kind = (
        F.when(strong & can_raise, "raise")
        .when(strong & legal["allin"].isNotNull() & (to_call > pot * 2), "allin")
        .when(opens, "raise")
        .when(playable & can_call & (to_call <= 5), "call")
        .when(marginal & check, "check")
        .when(marginal & can_call & (to_call <= 2) & (blind | late), "call")
        .when(check, "check")
        .otherwise("fold")
    )
    return F.struct(kind.alias("kind"), F.when(kind == "raise", F.when(strong & can_raise, to(size)).otherwise(to(2.5))).alias("amount_bb"))


def chat_records(df: DataFrame, system: str | None = None) -> DataFrame:
    """Decisions (system, prompt, output) as chat records of three messages."""
    role = F.lit(system) if system is not None else F.coalesce("system", F.lit(""))
    return df.where("trim(prompt) <> '' and trim(output) <> ''").select(prompts.messages(role, F.col("prompt"), F.col("output")).alias("messages"))


def scenario_records(df: DataFrame, system: str, preflop_only: bool = True) -> DataFrame:
    """Pairs (instruction, output) as chat records.

    ``preflop_only`` drops texts that name a flop unless ``preflop`` stands in their first 80 characters (so prompts that begin
    "Before the flop" go, too: the literal rule).
    """
    rows = df.where("trim(instruction) <> '' and trim(output) <> ''")
    if preflop_only:
        text = F.lower("instruction")
        rows = rows.where(~(F.contains(text, F.lit("flop")) & ~F.contains(F.substring(text, 1, 80), F.lit("preflop"))))
    return rows.select(prompts.messages(F.lit(system), F.col("instruction"), F.col("output")).alias("messages"))


def pending(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose row_id is not among those done."""
    return rows.join(done.select("row_id").distinct(), "row_id", "left_anti")
