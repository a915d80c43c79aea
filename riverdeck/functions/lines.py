"""Action lines (``UTG/2.0bb/CO/call``) as arrays of events, and what is derived from them."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, functions as F

from . import let

POSITIONS = ("UTG", "HJ", "CO", "BTN", "SB", "BB")
#: Words of a line and the action they stand for (fixed values).
VERBS = {"fold": "fold", "check": "check", "call": "call", "allin": "allin", "raise": "raise", "bet": "raise", "post": "post"}
#: Codes of actions in the action pattern (fixed values).
CODES = {"post": 0, "fold": 1, "call": 2, "raise": 3, "allin": 4, "check": 5}
AGGRESSIVE = ("raise", "allin")
_SIZE = r"(?i)^([0-9]+(?:\.[0-9]+)?)bb$"
EVENT = "struct<position:string,action:string,amount_bb:double>"


def position_index(position: Column) -> Column:
    """0 for UTG to 5 for BB; null for others."""
    at = F.array_position(F.array(*[F.lit(p) for p in POSITIONS]), position)
    return F.when(at > 0, (at - 1).cast("int"))


def tokens(line: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(line, F.lit("")), "/"), lambda x: F.trim(x)), lambda t: t != "")


def _amount(token: Column) -> Column:
    got = F.regexp_extract(F.coalesce(token, F.lit("")), _SIZE, 1)
    return F.when(got != "", got).cast("double")


def events(line: Column) -> Column:
    """array<struct<position, action, amount_bb>>: a position followed by a size (a raise) or a verb; ``allin`` may take a size.

    Positions and verbs have no word in common, so each token can be judged by itself and the next two.
    """
    verb = F.create_map(*[F.lit(x) for kv in VERBS.items() for x in kv])

    def judged(t: Column) -> Column:
        def at(here: Column, i: Column) -> Column:
            return let(F.get(t, i + 1), lambda a: let(_amount(a), lambda size: event(here, i, a, size)))

        def event(here: Column, i: Column, a: Column, size: Column) -> Column:
            word = F.try_element_at(verb, F.lower(a))
            action = F.when(size.isNotNull(), F.lit("raise")).otherwise(word)
            amount = F.when(size.isNotNull(), size).when(word == "allin", _amount(F.get(t, i + 2)))
            return F.struct(here.alias("position"), action.alias("action"), amount.alias("amount_bb"))

        # Only what stands at a position is looked at further.
        return F.filter(F.transform(t, lambda here, i: F.when(here.isin(*POSITIONS), at(here, i))), lambda e: e["action"].isNotNull())

    return let(tokens(line), judged)


def count_of(ev: Column, *actions: str) -> Column:
    return F.size(F.filter(ev, lambda e: e["action"].isin(*actions)))


def amounts(ev: Column) -> Column:
    return F.filter(F.transform(ev, lambda e: e["amount_bb"]), lambda a: a.isNotNull())


def last_amount(ev: Column) -> Column:
    return F.coalesce(F.try_element_at(amounts(ev), F.lit(-1)), F.lit(0.0))


def facing_bet(ev: Column) -> Column:
    return F.coalesce(F.array_max(amounts(ev)), F.lit(0.0))


def is_open(ev: Column) -> Column:
    """Nobody has raised or is all in."""
    return count_of(ev, *AGGRESSIVE) == 0


def last_aggressor(ev: Column, but: Column | None = None) -> Column:
    """Position of the last raise or all-in, of others than ``but`` if that is given."""
    keep = lambda e: e["action"].isin(*AGGRESSIVE) & (F.lit(True) if but is None else e["position"] != but)
    return F.try_element_at(F.filter(ev, keep), F.lit(-1))["position"]


def decision_type(ev: Column) -> Column:
    """What the hero faces; here all-ins aren't counted as raises."""
    raises, calls = count_of(ev, "raise"), count_of(ev, "call")
    return (
        F.when(count_of(ev, "allin") > 0, "allin_facing")
        .when((raises == 0) & (calls == 0), "unopened")
        .when(raises == 0, "limped_facing")
        .when(raises == 1, "open_raise_facing")
        .when(raises == 2, "3bet_facing")
        .otherwise("4bet+_facing")
    )


def villain_fold(ev: Column) -> Column:
    """1 if the first fold, call, raise or all-in after the last aggression is a fold, else 0; -1 if nothing follows or nobody was aggressive."""

    def answered(turned: Column) -> Column:
        after = F.slice(ev, F.size(ev) - turned + 2, F.greatest(turned - 1, F.lit(0)))
        answer = F.get(F.filter(after, lambda e: e["action"].isin("fold", "call", *AGGRESSIVE)), F.lit(0))["action"]
        return let(answer, lambda a: F.when((turned == 0) | a.isNull(), -1).when(a == "fold", 1).otherwise(0))

    return let(F.array_position(F.reverse(F.transform(ev, lambda e: e["action"].isin(*AGGRESSIVE))), True).cast("int"), answered)


def active_opponents(ev: Column, hero: Column) -> Column:
    """Positions other than the hero's whose last event isn't a fold: one pass that keeps a bit for each position."""
    bits = F.create_map(*[F.lit(x) for i, p in enumerate(POSITIONS) for x in (p, 1 << i)])

    def step(mask: Column, e: Column) -> Column:
        bit = F.coalesce(F.try_element_at(bits, e["position"]), F.lit(0))
        return F.when(e["position"] == hero, mask).when(e["action"] == "fold", mask.bitwiseAND(F.bitwise_not(bit))).otherwise(mask.bitwiseOR(bit))

    return F.bit_count(F.aggregate(ev, F.lit(0), step))


def format_g(x: Column) -> Column:
    """Up to six significant digits without trailing zeros, for sizes from 0.0001 up to a million."""
    digits = F.when(F.abs(x) >= 100000, 0).when(F.abs(x) >= 10000, 1).when(F.abs(x) >= 1000, 2).when(F.abs(x) >= 100, 3).when(F.abs(x) >= 10, 4).when(F.abs(x) >= 1, 5).otherwise(6)
    parts = [F.when(digits == d, F.format_string(f"%.{d}f", F.bround(x, d))) for d in range(7)]
    text = F.regexp_replace(F.regexp_replace(F.coalesce(*parts), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    # A number of 1 or more that has at most six digits and a point as it is written needs no rounding.
    own = x.cast("double").cast("string")
    short = F.when(own.endswith(".0"), F.substring(own, F.lit(1), F.length(own) - 2)).otherwise(own)
    return F.when((F.abs(x) >= 1) & (F.length(own) <= 7), short).otherwise(text)


def event_token(e: Column) -> Column:
    """``POS_action`` or ``POS_action_2.5bb``."""
    return F.concat_ws("_", e["position"], e["action"], F.when(e["amount_bb"].isNotNull(), F.concat(format_g(e["amount_bb"]), F.lit("bb"))))


def legacy_actions(line: Column) -> Column:
    """The older reading: tokens by twos, position then action; the first sized one is a bet, later ones raises; others as they stand."""
    raw = F.filter(tokens(line), lambda x, i: i % 2 == 1)
    sized = lambda x: F.contains(F.lower(x), F.lit("bb"))
    return let(raw, lambda r: F.transform(r, lambda x, i: F.when(~sized(x), x).when(F.exists(F.slice(r, 1, i), sized), "raise").otherwise("bet")))


def pattern_dimension(spark):
    """(pattern array<int>, action_pattern_hash): for each row of up to six action codes the hash of the tuple of codes, modulo 1000.

    55,987 rows of fixed number, from the interpreter's own rule for tuples of small integers.
    """
    rows = [(list(c), hash(c) % 1000) for n in range(7) for c in product(range(6), repeat=n)]
    return spark.createDataFrame(rows, "pattern array<int>, action_pattern_hash int")


def pattern(ev: Column) -> Column:
    code = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return F.transform(F.slice(ev, 1, 6), lambda e: F.coalesce(F.try_element_at(code, e["action"]), F.lit(0)))
