"""The 43 features of a decision, the opponent features, and population statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cards, labels, lines


def _number(c: Column) -> Column:
    return c.cast("double")


def card_features(hole: Column) -> dict[str, Column]:
    return {
        "hand_class_idx": _number(cards.hand_class_index(hole)),
        "high_rank": _number(cards.high(hole)),
        "low_rank": _number(cards.low(hole)),
        "is_pair": _number(cards.is_pair(hole).cast("int")),
        "is_suited": _number(cards.is_suited(hole).cast("int")),
        "is_connector": _number(cards.is_connector(hole).cast("int")),
        "is_broadway": _number(cards.is_broadway(hole).cast("int")),
        "gap": _number(cards.gap(hole)),
        "chen_strength": cards.chen(hole),
    }


def _by_hole(hole: Column) -> dict[str, Column]:
    return {**card_features(hole), "equity_vs_random": cards.equity_vs_random(hole)}


def hole_dimension(spark) -> DataFrame:
    """(hole, _card features): what depends on the two cards only, for each of the 52 x 52 pairs, a fixed number."""
    card = lambda i: F.concat(F.substring(F.lit(cards.RANKS), (i % 13 + 1).cast("int"), F.lit(1)), F.substring(F.lit(cards.SUITS), (F.floor(i / 13) + 1).cast("int"), F.lit(1)))
    holes = spark.range(52 * 52, numPartitions=1).select(F.concat(card(F.col("id") % 52), card(F.floor(F.col("id") / 52))).alias("hole"))
    return holes.select("hole", *[c.alias(f"_card_{name}") for name, c in _by_hole(F.col("hole")).items()])


def position_features(hero: Column, players: Column) -> dict[str, Column]:
    i = lines.position_index(hero)
    after = F.when(i < players, F.greatest(players - 1 - i, F.lit(0))).otherwise(0)
    return {
        "pos_idx": _number(i),
        "pos_is_blind": _number(hero.isin("SB", "BB").cast("int")),
        "pos_is_btn": _number((hero == "BTN").cast("int")),
        "pos_is_early": _number(hero.isin("UTG", "HJ").cast("int")),
        "seats_to_act_after": _number(after),
        "num_players": _number(players),
        "position_relative": _number(F.pmod(3 - i, F.lit(6))),
    }


def _of_events(ev: Column) -> dict[str, Column]:
    """What several features need of the events, to be columns of their own: Spark works out a lambda's value anew wherever it is written."""
    return {"_raises": lines.count_of(ev, *lines.AGGRESSIVE), "_callers": lines.count_of(ev, "call"), "_bet": lines.facing_bet(ev), "_aggressor": lines.last_aggressor(ev)}


def action_features(ev: Column, of: dict[str, Column] | None = None) -> dict[str, Column]:
    """Here all-ins count as raises; ``of``: what ``_of_events`` gives, where that is at hand as columns."""
    of = of or _of_events(ev)
    raises, callers = of["_raises"], of["_callers"]
    return {
        "num_events": _number(F.size(ev)),
        "num_raises": _number(raises),
        "num_callers": _number(callers),
        "num_folds": _number(lines.count_of(ev, "fold")),
        "num_allins": _number(lines.count_of(ev, "allin")),
        "last_bet_bb": lines.last_amount(ev),
        "max_bet_bb": of["_bet"],
        "aggressor_pos_idx": F.coalesce(_number(lines.position_index(of["_aggressor"])), F.lit(-1.0)),
        "is_open_pot": _number((raises == 0).cast("int")),
        "is_3bet_pot": _number((raises >= 2).cast("int")),
        "is_4bet_pot": _number((raises >= 3).cast("int")),
        "is_squeeze": _number(((raises >= 2) & (callers >= 1)).cast("int")),
    }


def stack_features(stack: Column, pot: Column, bet: Column) -> dict[str, Column]:
    call = F.greatest(bet, F.lit(0.0))
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    return {
        "hero_stack_bb": stack,
        "pot_bb": pot,
        "facing_bet_bb": bet,
        "pot_odds": ratio(call, call + pot),
        "spr_proxy": ratio(stack, pot),
        "allin_threshold": _number((stack <= 25).cast("int")),
        "deep_stack": _number((stack >= 100).cast("int")),
        "pot_commitment": ratio(bet, stack + pot),
        "effective_stack_bb": F.least(stack, pot + bet),
    }


def samples(raw: DataFrame) -> DataFrame:
    """Scenario rows as decision samples: trimmed position and hand, stack 100 where missing or 0, parsed events and moves."""
    return raw.select(
        "split", "source_index",
        F.trim("hero_pos").alias("hero_pos"), F.trim("hero_holding").alias("hero_hole"),
        F.coalesce(F.nullif("hero_stack_bb", F.lit(0.0)), F.lit(100.0)).alias("stack"),
        "num_players", F.coalesce("num_bets", F.lit(0)).alias("num_bets"), F.coalesce("pot_size", F.lit(0.0)).alias("pot"),
        labels.moves(F.col("available_moves"), "whole").alias("moves"), lines.events(F.col("prev_line")).alias("events"), "correct_decision",
    )


def reject_reason(df: DataFrame) -> Column:
    """Why a sample is invalid; null if it is valid."""
    return (
        F.when(~cards.is_valid_hole(F.col("hero_hole")), "hole")
        .when(~F.col("hero_pos").isin(*lines.POSITIONS), "position")
        .when(~F.col("num_players").between(1, 9), "players")
        .when((F.col("pot") < 0) | (F.col("stack") < 0) | (F.col("num_bets") < 0), "negative")
    )


FEATURES = (
    "hand_class_idx high_rank low_rank is_pair is_suited is_connector is_broadway gap chen_strength equity_vs_random equity_vs_range "
    "pos_idx pos_is_blind pos_is_btn pos_is_early seats_to_act_after num_players position_relative "
    "num_events num_raises num_callers num_folds num_allins last_bet_bb max_bet_bb aggressor_pos_idx is_open_pot is_3bet_pot is_4bet_pot is_squeeze action_pattern_hash "
    "hero_stack_bb pot_bb facing_bet_bb pot_odds spr_proxy allin_threshold deep_stack pot_commitment effective_stack_bb can_check can_fold can_call"
).split()


def features(df: DataFrame, single: bool = False) -> DataFrame:
    """split, source_index, the 43 features in order and ``label``; ``single`` casts to float at the end."""
    ev, hole = F.col("events"), F.col("hero_hole")
    has = lambda m: _number(F.array_contains(F.transform("moves", lambda x: F.lower(x)), m).cast("int"))
    # A hand that is no pair of cards is not in the dimension: only there the expressions are worked out.
    by_hole = {name: F.coalesce(f"_card_{name}", c) for name, c in _by_hole(hole).items()}
    made = {
        **by_hole,
        "equity_vs_range": by_hole["equity_vs_random"] * cards.range_factor(F.col("_aggressor")),
        **position_features(F.col("hero_pos"), F.col("num_players")),
        **action_features(ev, {name: F.col(name) for name in _of_events(ev)}),
        **stack_features(F.col("stack"), F.col("pot"), F.col("_bet")),
        **{f"can_{m}": has(m) for m in ("check", "fold", "call")},
    }
    dimension, holes = lines.pattern_dimension(df.sparkSession), hole_dimension(df.sparkSession)
    wide = df.withColumns({"pattern": lines.pattern(ev), **_of_events(ev)}).join(F.broadcast(dimension), "pattern", "left")  # 55,987 rows
    wide = wide.join(F.broadcast(holes), F.col("hero_hole") == F.col("hole"), "left")  # 2,704 rows
    made["action_pattern_hash"] = _number(F.col("action_pattern_hash"))
    kind = "float" if single else "double"
    return wide.select("split", "source_index", *[F.coalesce(made[c], F.lit(0.0)).cast(kind).alias(c) for c in FEATURES], labels.canonical(F.col("correct_decision")).alias("label"), lines.villain_fold(ev).alias("villain_fold"))


def population(df: DataFrame, key: tuple[str, ...] = ("split", "source_index")) -> DataFrame:
    """Statistics of each position over hands, which ``key`` tells apart: only the first action of a position in a hand counts."""
    one = df.select(*key, F.posexplode("events").alias("i", "e")).select(*key, "i", F.col("e.position").alias("position"), F.col("e.action").alias("action"))
    first = one.withColumn("r", F.row_number().over(Window.partitionBy(*key, "position").orderBy("i"))).where("r = 1")
    raised = F.col("action").isin(*lines.AGGRESSIVE)
    before = F.coalesce(F.max(raised.cast("int")).over(Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = first.withColumn("facing", before)
    n = lambda c: F.sum(c.cast("int"))
    facing = F.col("facing") == 1
    sums = seen.groupBy("position").agg(F.count("*").alias("hands"), n(F.col("action").isin("call", *lines.AGGRESSIVE)).alias("vpip_n"), n(raised).alias("pfr_n"), n(raised & facing).alias("three_bet_n"), n(facing).alias("facing_n"), n(facing & (F.col("action") == "fold")).alias("fold_n"))
    some = F.greatest("facing_n", F.lit(1))
    rates = sums.select("position", "hands", (F.col("vpip_n") / F.col("hands")).alias("vpip"), (F.col("pfr_n") / F.col("hands")).alias("pfr"), (F.col("three_bet_n") / some).alias("three_bet_pct"), (F.col("fold_n") / some).alias("fold_to_raise_pct"))
    return rates.withColumn("aggression", F.col("pfr") / F.greatest("vpip", F.lit(0.01)))


def opponent_features(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Active opponents, and the statistics of the last aggressor other than the hero; zeros where there is none."""
    ev, hero = F.col("events"), F.col("hero_pos")
    out = df.select("split", "source_index", lines.active_opponents(ev, hero).alias("n_active_opponents"), lines.last_aggressor(ev, hero).alias("position"))
    names = ("vpip", "pfr", "three_bet_pct", "fold_to_raise_pct", "aggression")
    joined = out.join(F.broadcast(stats), "position", "left")  # one row a position
    return joined.select("split", "source_index", "n_active_opponents", *[F.coalesce(n, F.lit(0.0)).alias(f"villain_{n}") for n in names])


def flat(df: DataFrame) -> DataFrame:
    """Samples as a flat frame for exploration; moves joined by commas."""
    return df.select("split", "source_index", "hero_pos", "hero_hole", cards.hand_class(F.col("hero_hole")).alias("hand_class"), "num_players", "num_bets", "pot", F.size("events").alias("n_actions"), F.array_join("moves", ",").alias("moves"), labels.canonical(F.col("correct_decision")).alias("label"))


#: Groups of starting hands in the older features, best first (fixed values); all others are group 9.
GROUPS = (
    "AA KK QQ JJ AKs",
    "TT AQs AJs KQs AKo",
    "99 AQo AJo KQo KJs ATs A9s",
    "88 KJo QJs JTs ATo KTs",
    "77 66 A9o A8s A7s KTo QTs JTo",
    "55 44 A8o A7o A6s A5s A4s A3s A2s",
    "33 22 K9s Q9s J9s T9s 98s",
    "K9o Q9o J9o T9o 98o 87s 76s 65s",
)


def legacy_strength(hole: Column) -> dict[str, Column]:
    group = F.coalesce(F.try_element_at(cards.lookup({h: i for i, g in enumerate(GROUPS, 1) for h in g.split()}), cards.hand_class(hole)), F.lit(9))
    return {"hand_group": group, "hand_strength": 1.0 / group, "is_premium": (group <= 2).cast("int"), "is_playable": (group <= 5).cast("int")}


def legacy_pot(pot: Column, call: Column) -> dict[str, Column]:
    """Pot odds and stack-to-pot ratio of the older features: a stack of five pots, the ratio capped at 50 and 999 without pot."""
    spr = F.when(pot > 0, F.least(F.lit(50.0), 5 * pot / F.when(pot > 0, pot))).otherwise(999.0)
    return {"pot_odds_legacy": F.when(call > 0, pot / F.when(call > 0, pot + call)).otherwise(0.0), "spr_legacy": spr}


def overwrite_merge(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """New columns beside the old ones; one of the same name takes the old one's place."""
    return df.withColumns(new)


def legacy_position(position: Column, players: Column) -> dict[str, Column]:
    """The older position features; an unknown position has index -1."""
    i = F.coalesce(lines.position_index(position), F.lit(-1))
    flag = lambda *p: position.isin(*p).cast("int")
    return {
        "position_idx": i,
        "is_early_position": flag("UTG", "HJ"),
        "is_middle_position": flag("CO"),
        "is_late_position": flag("BTN"),
        "is_blind": flag("SB", "BB"),
        "position_strength": (i + 1) / 6,
        "relative_position": F.when(players > 0, i / F.when(players > 0, players)).otherwise(0.0),
    }


#: Action names of the older encoding, by index (fixed values).
LEGACY_ACTIONS = ("fold", "check", "call", "bet", "raise", "allin")


def legacy_actions(seq: Column, amounts: Column) -> dict[str, Column]:
    """The older encoding of an array of action names and their amounts: counts, aggression capped at 10, the last action's index (-1 without one) and amount."""
    kinds = ("fold", "call", "bet", "raise", "allin")
    # The first of the kinds that a name holds counts.
    of = lambda a: F.coalesce(*[F.when(F.contains(F.lower(a), F.lit(k)), k) for k in kinds])
    counted = lambda k: F.size(F.filter(seq, lambda a: of(a) == k))
    n = {k: counted(k) for k in kinds}
    aggressive = n["bet"] + n["raise"] + n["allin"]
    factor = F.when(n["call"] > 0, aggressive / F.when(n["call"] > 0, n["call"])).otherwise(aggressive.cast("double"))
    last = F.array_position(F.array(*[F.lit(a) for a in LEGACY_ACTIONS]), F.lower(F.try_element_at(seq, F.lit(-1))))
    return {
        "action_count": F.size(seq),
        "fold_count": n["fold"],
        "call_count": n["call"],
        "raise_count": n["bet"] + n["raise"],
        "allin_count": n["allin"],
        "aggression_factor": F.least(factor, F.lit(10.0)),
        "last_action_type": F.coalesce(F.when(last > 0, last - 1), F.lit(-1)).cast("int"),
        "last_action_amount": F.coalesce(F.try_element_at(amounts, F.lit(-1)), F.lit(0.0)),
    }


def legacy_counts(seq: Column) -> dict[str, Column]:
    """Per kind, the actions whose name holds it (a name may count for several)."""
    holding = lambda k: F.size(F.filter(seq, lambda a: F.contains(F.lower(a), F.lit(k))))
    return {"num_actions": F.size(seq), **{f"num_{k}": holding(k) for k in ("fold", "call", "bet", "raise", "allin")}}


def legacy_pot_features(pot: Column, stack: Column, bet: Column) -> dict[str, Column]:
    spr = F.when(pot > 0, stack / F.when(pot > 0, pot)).otherwise(999.0)
    part = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    return {
        "spr": F.least(spr, F.lit(50.0)),
        "pot_to_stack_ratio": part(pot, stack),
        "is_low_spr": (spr < 3).cast("int"),
        "is_medium_spr": spr.between(3, 8).cast("int"),
        "is_high_spr": (spr > 8).cast("int"),
        "last_bet_to_pot": part(bet, pot),
        "pot_odds": F.when(bet > 0, pot / F.when(bet > 0, pot + bet)).otherwise(0.0),
    }


def legacy_cards(hand: Column) -> dict[str, Column]:
    """Ranks and suits of a hand of four characters; ``?`` where it has others."""
    part = lambda i: F.when(F.length(hand) == 4, F.substring(hand, i, 1)).otherwise("?")
    return {"card1_rank": part(1), "card1_suit": part(2), "card2_rank": part(3), "card2_suit": part(4)}


def numeric_columns(df: DataFrame, targets: tuple[str, ...] = ("label", "villain_fold", "y")) -> list[str]:
    """Columns of a numeric type that are no targets."""
    from pyspark.sql import types as T

    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in targets]


def made_hand(score: Column, hole: Column) -> Column:
    """0 nothing, 1 a pair with one hole card or on the board, 2 a pocket pair or two pair, 3 better; from a score of hand and board."""
    kind, paired = F.get(score, F.lit(0)), F.get(score, F.lit(1))
    pocket = (cards.high(hole) == paired) & (cards.low(hole) == paired)
    return F.when(kind >= 3, 3).when(kind == 2, 2).when(kind == 1, F.when(pocket, 2).otherwise(1)).otherwise(0)
