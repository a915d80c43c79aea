"""Hole cards and board cards as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import let

RANKS = "23456789TJQKA"
SUITS = "shdc"

#: Heads-up equity against a random hand, by class (fixed values).
EQUITY = {
    "AA": 0.852, "KK": 0.824, "QQ": 0.799, "JJ": 0.774, "TT": 0.750, "99": 0.720, "88": 0.691,
    "77": 0.663, "66": 0.633, "55": 0.601, "44": 0.570, "33": 0.538, "22": 0.503,
    "AKs": 0.671, "AQs": 0.660, "AJs": 0.649, "ATs": 0.636, "A9s": 0.616, "A8s": 0.608,
    "A7s": 0.593, "A6s": 0.578, "A5s": 0.583, "A4s": 0.575, "A3s": 0.568, "A2s": 0.560,
    "AKo": 0.652, "AQo": 0.643, "AJo": 0.629, "ATo": 0.616, "A9o": 0.594, "A8o": 0.585,
    "A7o": 0.569, "A6o": 0.553, "A5o": 0.559, "A4o": 0.550, "A3o": 0.542, "A2o": 0.533,
    "KQs": 0.632, "KJs": 0.620, "KTs": 0.610, "K9s": 0.588, "K8s": 0.564, "K7s": 0.554,
    "K6s": 0.544, "K5s": 0.533, "K4s": 0.523, "K3s": 0.514, "K2s": 0.505,
    "KQo": 0.611, "KJo": 0.599, "KTo": 0.588,
    "QJs": 0.603, "QTs": 0.593, "Q9s": 0.573, "JTs": 0.585, "J9s": 0.567, "T9s": 0.569,
    "98s": 0.549, "87s": 0.531, "76s": 0.513, "65s": 0.494, "54s": 0.474,
    "72o": 0.348, "83o": 0.371, "62o": 0.354, "52o": 0.371, "42o": 0.363, "32o": 0.355,
    "73o": 0.359, "93o": 0.383, "T2o": 0.416, "J2o": 0.446,
}
#: How much a villain's position narrows the range that equity is taken against (fixed values); others 0.92.
RANGE_FACTOR = {"UTG": 0.85, "HJ": 0.88, "CO": 0.92, "BTN": 0.95, "SB": 0.90, "BB": 1.00}
OTHER_FACTOR = 0.92
RANK_NAMES = dict(zip(RANKS, "Two Three Four Five Six Seven Eight Nine Ten Jack Queen King Ace".split()))
SUIT_NAMES = {"s": "Spade", "h": "Heart", "d": "Diamond", "c": "Club"}


def lookup(values: dict) -> Column:
    """A literal map, folded by the optimizer."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def rank(card: Column) -> Column:
    """2 to 14; null for anything but a rank sign."""
    at = F.instr(F.lit(RANKS), F.upper(F.substring(card, 1, 1)))
    return F.when((at > 0) & (F.length(card) > 0), at + 1).cast("int")


def suit(card: Column) -> Column:
    s = F.lower(F.substring(card, 2, 1))
    return F.when(s.isin(*SUITS), s)


def first(hole: Column) -> Column:
    return F.substring(hole, 1, 2)


def second(hole: Column) -> Column:
    return F.substring(hole, 3, 2)


def high(hole: Column) -> Column:
    return F.greatest(rank(first(hole)), rank(second(hole)))


def low(hole: Column) -> Column:
    return F.least(rank(first(hole)), rank(second(hole)))


def is_pair(hole: Column) -> Column:
    return high(hole) == low(hole)


def is_suited(hole: Column) -> Column:
    """Never true of a pair."""
    return (suit(first(hole)) == suit(second(hole))) & ~is_pair(hole)


def is_broadway(hole: Column) -> Column:
    return low(hole) >= 10


def gap(hole: Column) -> Column:
    return F.greatest(F.lit(0), high(hole) - low(hole) - 1)


def is_connector(hole: Column) -> Column:
    return (gap(hole) == 0) & ~is_pair(hole)


def _sign(value: Column) -> Column:
    return F.substring(F.lit(RANKS), (value - 1).cast("int"), F.lit(1))


def hand_class(hole: Column) -> Column:
    """One of 169: ``AA``, ``AKs``, ``AKo``."""
    both = F.concat(_sign(high(hole)), _sign(low(hole)))
    return F.when(is_pair(hole), both).otherwise(F.concat(both, F.when(is_suited(hole), "s").otherwise("o")))


def hand_class_index(hole: Column) -> Column:
    """Place in the 13 x 13 grid from ace to two, row by row; suited hands stand above the diagonal."""
    i, j = 14 - high(hole), 14 - low(hole)
    return F.when(is_suited(hole) | is_pair(hole), i * 13 + j).otherwise(j * 13 + i)


def chen(hole: Column) -> Column:
    h, g = high(hole), gap(hole)
    top = F.when(h == 14, 10.0).when(h == 13, 8.0).when(h == 12, 7.0).when(h == 11, 6.0).otherwise(h / 2.0)
    pair = F.when(h == 5, 6.0).otherwise(F.greatest(F.lit(5.0), top * 2.0))
    penalty = F.when(g == 0, 0.0).when(g == 1, 1.0).when(g == 2, 2.0).when(g == 3, 4.0).otherwise(5.0)
    suited = F.when(is_suited(hole), 2.0).otherwise(0.0)
    straight = F.when((g <= 1) & (h < 12), 1.0).otherwise(0.0)
    return F.when(is_pair(hole), pair).otherwise(top - penalty + suited + straight)


def chen_to_equity(score: Column) -> Column:
    """Linear from 0.30 at -1 to 0.70 at 20."""
    return 0.30 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + 1.0) / 21.0)) * 0.40


def equity_vs_random(hole: Column) -> Column:
    return F.coalesce(F.try_element_at(lookup(EQUITY), hand_class(hole)), chen_to_equity(chen(hole)))


def equity_vs_range(hole: Column, villain: Column) -> Column:
    """Without villain position, the equity against a random hand."""
    return equity_vs_random(hole) * range_factor(villain)


def range_factor(villain: Column) -> Column:
    return F.when(villain.isNull(), 1.0).otherwise(F.coalesce(F.try_element_at(lookup(RANGE_FACTOR), villain), F.lit(OTHER_FACTOR)))


def is_valid_hole(hole: Column) -> Column:
    """Two different cards of known ranks and suits."""
    return F.coalesce(F.rlike(hole, F.lit("^([2-9TJQKA][shdc]){2}$")) & (first(hole) != second(hole)), F.lit(False))


def english(card: Column) -> Column:
    """``Ah`` to ``Ace of Heart``; anything else unchanged."""
    r = F.try_element_at(lookup(RANK_NAMES), F.substring(card, 1, 1))
    s = F.try_element_at(lookup(SUIT_NAMES), F.substring(card, 2, 1))
    return F.when((F.length(card) == 2) & r.isNotNull() & s.isNotNull(), F.concat(r, F.lit(" of "), s)).otherwise(card)


def cards_of(text: Column) -> Column:
    """A string of cards, with or without blanks, as an array of two-character cards."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([2-9TJQKA][shdc])"), F.lit(1))


def _count(a: Column, of: Column) -> Column:
    return F.size(F.filter(a, lambda x: x == of))


def longest_run(values: Column) -> Column:
    """Longest run of consecutive ranks, for an array of distinct ranks."""
    step = F.transform(values, lambda v: F.aggregate(F.sequence(F.lit(0), F.lit(12)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, i: F.struct((s["n"] + F.when(s["on"] & F.array_contains(values, v + i), 1).otherwise(0)).alias("n"), (s["on"] & F.array_contains(values, v + i)).alias("on")), lambda s: s["n"]))
    return F.coalesce(F.array_max(step), F.lit(0))


BOARD_FEATURES = ("board_high_card board_low_card board_spread board_is_paired board_is_trips board_is_monotone board_flush_possible board_flush_draw board_max_suit_count board_straight_possible board_max_connected board_num_broadway board_num_low board_n_cards").split()


def board_texture(board: Column) -> dict[str, Column]:
    """The 14 board features of an array of cards; all 0 for an empty board."""
    ranks, suits = F.transform(board, rank), F.transform(board, suit)
    most = lambda a: let(a, lambda v: F.array_max(F.transform(v, lambda x: _count(v, x))))
    n, most_rank, most_suit = F.size(board), most(ranks), most(suits)
    run = let(F.array_distinct(ranks), longest_run)
    hi, lo = F.array_max(ranks), F.array_min(ranks)
    wheel = F.array_contains(ranks, 14) & F.array_contains(ranks, 2) & F.array_contains(ranks, 3)
    values = [
        hi, lo, hi - lo, (most_rank >= 2).cast("int"), (most_rank >= 3).cast("int"),
        ((most_suit == n) & (n >= 3)).cast("int"), (most_suit >= 3).cast("int"), (most_suit >= 2).cast("int"), most_suit,
        ((run >= 3) | wheel).cast("int"), run, F.size(F.filter(ranks, lambda r: r >= 10)), F.size(F.filter(ranks, lambda r: r <= 6)), n,
    ]
    return {k: F.when(n == 0, 0.0).otherwise(v.cast("double")) for k, v in zip(BOARD_FEATURES, values)}


def straight_high(values: Column) -> Column:
    """Top rank of five in a row, the ace also low; null if there is none."""

    def have(h: Column, d: int) -> Column:
        return F.array_contains(values, F.when(h - d == 1, 14).otherwise(h - d))

    tops = F.filter(F.sequence(F.lit(14), F.lit(5), F.lit(-1)), lambda h: have(h, 0) & have(h, 1) & have(h, 2) & have(h, 3) & have(h, 4))
    return F.get(tops, F.lit(0))


def with_score(df: DataFrame, cards: str, to: str = "score") -> DataFrame:
    """``df`` with the best five of up to seven cards as an array of ints that compares like the hand: category 0 (high card) to 8 (straight flush), then ranks.

    Works on histograms of ranks and suits, in steps so that each is worked out once, without enumerating hands of five.
    """
    c = F.col(cards)
    df = df.withColumns({"_ranks": F.transform(c, rank), "_suits": F.transform(c, suit)})
    suited = F.get(F.filter(F.array(*[F.lit(s) for s in SUITS]), lambda s: _count(F.col("_suits"), s) >= 5), F.lit(0))
    # Ranks by how often they occur, then by size.
    groups = F.sort_array(F.transform(F.array_distinct("_ranks"), lambda r: F.struct(_count(F.col("_ranks"), r).alias("n"), r.alias("r"))), asc=False)
    df = df.withColumns({"_flush": suited, "_groups": groups, "_run": straight_high(F.col("_ranks"))})
    same = F.when(F.col("_flush").isNotNull(), F.sort_array(F.transform(F.filter(c, lambda x: suit(x) == F.col("_flush")), rank), asc=False))
    df = df.withColumn("_same", same)
    for i in range(2):
        g = F.get("_groups", F.lit(i))
        df = df.withColumns({f"_n{i}": F.coalesce(g["n"], F.lit(0)), f"_r{i}": g["r"]})
    rest = lambda *used: F.sort_array(F.filter(F.array_distinct("_ranks"), lambda r: ~r.isin(*[F.col(u) for u in used])), asc=False)
    full = F.array_max(F.transform(F.filter("_groups", lambda g: (g["n"] >= 2) & (g["r"] != F.col("_r0"))), lambda g: g["r"]))
    df = df.withColumns({"_full": full, "_flush_run": F.when(F.col("_flush").isNotNull(), straight_high(F.col("_same")))})

    def hand(n: int, *parts) -> Column:
        """Strings name single ranks, Columns are arrays of them."""
        return F.concat(F.array(F.lit(n)), *[F.array(F.col(x)) if isinstance(x, str) else x for x in parts])

    n0, n1 = F.col("_n0"), F.col("_n1")
    scored = (
        F.when(F.col("_flush_run").isNotNull(), hand(8, "_flush_run"))
        .when(n0 >= 4, hand(7, "_r0", F.slice(rest("_r0"), 1, 1)))
        .when((n0 == 3) & F.col("_full").isNotNull(), hand(6, "_r0", "_full"))
        .when(F.col("_flush").isNotNull(), hand(5, F.slice("_same", 1, 5)))
        .when(F.col("_run").isNotNull(), hand(4, "_run"))
        .when(n0 == 3, hand(3, "_r0", F.slice(rest("_r0"), 1, 2)))
        .when((n0 == 2) & (n1 == 2), hand(2, "_r0", "_r1", F.slice(rest("_r0", "_r1"), 1, 1)))
        .when(n0 == 2, hand(1, "_r0", F.slice(rest("_r0"), 1, 3)))
        .otherwise(hand(0, F.slice(F.sort_array("_ranks", asc=False), 1, 5)))
    )
    helpers = ["_ranks", "_suits", "_flush", "_groups", "_run", "_same", "_full", "_flush_run", "_n0", "_r0", "_n1", "_r1"]
    return df.withColumn(to, scored).drop(*helpers)


CATEGORIES = ("high_card", "pair", "two_pair", "trips", "straight", "flush", "full_house", "quads", "straight_flush")


def category(scored: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in CATEGORIES]), F.get(scored, F.lit(0)))
