"""Rule-based reasoning texts for scenarios, as Column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F

from . import prompts

#: What is said of the action before the hero, by the first expression that matches (fixed values).
SITUATIONS = (
    (r"(?i)3[- ]?bet|reraise", "Villain has 3-bet, so the pot is inflated and ranges are tighter."),
    (r"(?i)\ball[- ]?in\b|shove", "With an all-in on the table this is a pot-odds vs equity decision."),
    (r"(?i)\bcall\b|\blimp\b", "Because there is already a caller, our value threshold rises."),
)
UNOPENED = "The pot is un-opened relative to hero, so we lean on our opening range."
#: What is said of the decision (fixed values).
VERDICTS = {
    "fold": "Given the position and current action, the hand is dominated by villain's continuing range, so folding is the highest-EV line.",
    "check": "With no bet to face, checking realises equity cheaply.",
    "call": "The pot odds justify a call: hero has enough equity vs villain's range given position and stack depth.",
    "raise": "Raising builds the pot with a hand that has both equity and playability, and denies equity to villain's marginal continues.",
    "allin": "Jamming maximises fold equity while getting stacks in with a hand that flips or dominates most of villain's calling range.",
}
OTHER = "This is the solver-preferred line for the given stack, pot, and range."


def _any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text, in lower case, holds one of the words."""
    return functools.reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in words])


def _find(text: Column, pattern: str, *words: str) -> Column:
    """What the expression finds; ``words``: one of them is in every text where it finds something, so that others needn't be scanned."""
    got = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.when(_any(text, words), got) if words else got


def facts(text: Column) -> dict[str, Column]:
    """Position, hand, stack, pot and bet that the text names; null where it names none."""
    number = r"([0-9]+(?:\.[0-9]+)?)"
    return {
        "position": F.upper(F.coalesce(_find(text, r"\bposition\s*[:=]\s*([A-Za-z]+)", ":", "="), _find(text, r"\b(UTG|HJ|CO|BTN|SB|BB)\b"))),
        "hole": _find(text, r"\b([2-9TJQKA][shdc][2-9TJQKA][shdc])\b"),
        "stack": _find(text, rf"(?i)stack[^0-9]*{number}\s*bb", "stack"),
        "pot": _find(text, rf"(?i)pot[^0-9]*{number}\s*bb", "pot"),
        "bet": _find(text, rf"(?:bets?|raises?\s+to|to)\s+{number}\s*BB"),
    }


def _by(text: Column, cases, other: str) -> Column:
    out = F.lit(other)
    for pattern, said in reversed(cases):
        out = F.when(_any(text, HOLDS[pattern]) & F.rlike(text, F.lit(pattern)), said).otherwise(out)
    return out


def concise(instruction: Column, gold: Column) -> Column:
    """A short paragraph and the decision."""
    text = F.coalesce(instruction, F.lit(""))
    f = facts(text)
    hero = F.concat_ws(", ", F.concat(F.lit("Hero is in "), f["position"]), F.concat(F.lit("holding "), f["hole"]))
    spot = F.concat_ws(" and ", F.concat(F.lit("an effective stack near "), f["stack"], F.lit("bb")), F.concat(F.lit("a pot of "), f["pot"], F.lit("bb")))
    verb = F.lower(F.get(F.split(F.trim(gold), r"\s+"), F.lit(0)))
    verdict = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in {**VERDICTS, "bet": VERDICTS["raise"]}.items() for x in (k, v)]), verb), F.lit(OTHER))
    parts = [F.when(hero != "", F.concat(hero, F.lit("."))), F.when(spot != "", F.concat(F.lit("The spot has "), spot, F.lit("."))), _by(text, SITUATIONS, UNOPENED), verdict]
    return F.concat(F.concat_ws(" ", *parts), F.lit("\nDecision: "), F.trim(gold))


#: What the structured text says of the action before, by the first expression that matches (fixed values).
RANGES = (
    (r"(?i)3[- ]?bet|reraise", "**Range vs Range**: Facing a 3-bet the pot is inflated and villain's range is tight."),
    (r"(?i)\ball[- ]?in\b|jam|shove", "**Facing all-in**: This is a pot-odds vs equity decision — no future streets."),
)
#: Of these, in lower case, every text has one that the expression matches.
HOLDS = {SITUATIONS[0][0]: ("bet", "reraise"), SITUATIONS[1][0]: ("allin", "all-in", "all in", "shove"), SITUATIONS[2][0]: ("call", "limp"), RANGES[1][0]: ("allin", "all-in", "all in", "jam", "shove")}
STANDARD = "**Range vs Range**: Standard range asymmetry for this position and prior action."
#: What the structured text says of the hand and of the line, by the decision's first word (fixed values).
STRENGTH = {
    "fold": ("Hero's holding is dominated by villain's continuing range.", "Folding is the maximum-EV line; calling burns chips."),
    "call": ("Hero has enough equity to continue given position and stack depth.", "Call to realise equity; 3-betting over-inflates the pot with a marginal hand."),
    "check": ("Medium — checking realises equity cheaply and keeps villain's range wide.", "Check to induce bluffs and control pot size."),
    "raise": ("Strong equity + playability; the hand prefers a bigger pot.", "Bet / raise for value and to deny equity to villain's marginal continues."),
    "allin": ("Enough equity to get stacks in; fold equity is a bonus.", "Jam to maximise fold equity while flipping or dominating villain's call range."),
}
#: What is said where a text names no number (fixed value).
NO_NUMBERS = "* (No explicit stack / pot numbers were parsed from the prompt.)"


def numbers(instruction: Column) -> Column:
    """The lines of pot, bet, required equity, stack-to-pot ratio and stack; one line that says so if there are none."""
    f = facts(F.coalesce(instruction, F.lit("")))
    pot, bet, stack = (f[k].cast("double") for k in ("pot", "bet", "stack"))
    odds, ratio = F.try_divide(bet, pot + bet) * 100, F.try_divide(stack, pot)
    said = F.concat_ws(
        "\n",
        F.concat(F.lit("* Pot size: "), f["pot"], F.lit(" BB")),
        F.concat(F.lit("* Bet to call: "), f["bet"], F.lit(" BB")),
        F.when(odds.isNotNull(), F.concat(F.lit("* Required equity: "), F.format_string("%.1f", odds), F.lit("%"))),
        F.when(ratio.isNotNull(), F.concat(F.lit("* SPR: "), F.format_string("%.2f", ratio))),
        F.concat(F.lit("* Effective stack: "), f["stack"], F.lit(" BB")),
    )
    return F.when(said != "", said).otherwise(NO_NUMBERS)


def structured(instruction: Column, gold: Column) -> Column:
    """Three sections: a numbered analysis (hero, ranges, the hand's strength and the line, as far as they are known), the numbers, the action."""
    text = F.coalesce(instruction, F.lit(""))
    f = facts(text)
    who = F.concat_ws(", ", F.concat(F.lit("in "), f["position"]), F.concat(F.lit("holding "), f["hole"]))
    word = F.lower(F.get(F.split(F.trim(gold), r"\s+"), F.lit(0)))
    verb = F.when(word == "bet", "raise").when(word == "", "check").otherwise(word)
    by_verb = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in STRENGTH.items() for x in (k, v[i])]), verb)
    said = F.array(
        F.when(who != "", F.concat(F.lit("**Hero snapshot**: Hero is "), who, F.lit("."))),
        _by(text, RANGES, STANDARD),
        F.concat(F.lit("**Hand strength**: "), by_verb(0)),
        F.concat(F.lit("**GTO strategy**: "), by_verb(1)),
    )
    analysis = F.array_join(F.transform(F.array_compact(said), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return F.concat(F.lit("### Strategic Analysis\n"), analysis, F.lit("\n\n### Mathematical Calculations\n"), numbers(instruction), F.lit("\n\n### Action\n"), prompts.action_line(gold))


def render_line(position: str, action: str, amount: str) -> Column:
    """One action of a log: ``BTN/2.5bb``, ``SB/allin/24bb``, ``BB/fold``."""
    from .lines import format_g

    a, size = F.col(action), F.concat(format_g(F.coalesce(amount, F.lit(0.0))), F.lit("bb"))
    return F.when(a == "raise", F.concat_ws("/", F.col(position), size)).when((a == "allin") & F.col(amount).isNotNull(), F.concat_ws("/", F.col(position), a, size)).otherwise(F.concat_ws("/", F.col(position), a))


def render_prompt(hero: Column, hole: Column, seats: Column, players: Column, stack: Column, pot: Column, to_call: Column, line: Column, moves: Column) -> Column:
    """The whole text of a decision, in the layout that the slot expressions read."""
    from . import cards
    from .lines import format_g

    held = F.concat(cards.english(cards.first(hole)), F.lit(" and "), cards.english(cards.second(hole)))
    before = F.when(F.coalesce(line, F.lit("")) == "", "Before the flop, no action yet. ").otherwise(F.concat(F.lit("Before the flop, "), line, F.lit(". Assume that all other players that is not mentioned folded. ")))
    return F.concat(
        F.lit("You are playing a "), players.cast("string"), F.lit("-handed No Limit Texas Hold'em cash game. The player positions involved in this game are "), F.array_join(seats, ", "),
        F.lit(". The small blind is 0.5 chips and the big blind is 1 chips. Everyone started with "), format_g(stack), F.lit(" chips.\nIn this hand, your position is "), hero,
        F.lit(", and your holding is ["), held, F.lit("]. "), before, F.lit("The current pot size is "), format_g(pot), F.lit(" chips. You need "), format_g(to_call),
        F.lit(" chips to call. Decide the optimal action from "), F.array_join(F.transform(moves, lambda m: F.concat(F.lit("'"), m, F.lit("'"))), ", "), F.lit("."),
    )
