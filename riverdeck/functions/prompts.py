"""Scenario prompts: slots, template shells, hashes, rendering, and the reading of free-text answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import cards, let, lines

_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
#: Expressions of the slots (fixed values).
HOLDING = r"(?i)\[(\w+)\s+of\s+(\w+)\s+and\s+(\w+)\s+of\s+(\w+)\]"
POT = rf"(?i)current pot size is {_NUMBER}\s*chips"
BLINDS = rf"(?i)small blind is {_NUMBER}\s*chips? and the big blind is {_NUMBER}\s*chips?"
STACK = rf"(?i)Everyone started with {_NUMBER}\s*chips"
TABLE = r"(?i)(\d+)-handed"
SEATS = r"(?i)player positions involved in this game are\s+([A-Za-z0-9,\s]+?)\."
HERO = r"(?i)your position is\s+([A-Z]{2,3})\s*,"
#: Masks of the template shell, in order (fixed values).
MASKS = (
    (HOLDING, "[<HOLDING>]"),
    (r"(?i)\d+-handed", "<N>-handed"),
    (r"(?i)small blind is [0-9.]+ chips? and the big blind is [0-9.]+ chips?", "small blind is <SB> chips and the big blind is <BB> chips"),
    (r"(?i)Everyone started with [0-9.]+ chips", "Everyone started with <STACK> chips"),
    (r"(?i)your position is\s+[A-Z]{2,3}", "your position is <POS>"),
    (r"(?i)player positions involved in this game are\s+[A-Za-z0-9,\s]+?\.", "player positions involved in this game are <POSITIONS>."),
    (r"(?i)current pot size is [0-9.]+\s*chips", "current pot size is <POT> chips"),
    (
        r"(?is)Before the flop, .+?\. Assume that all other players that is not mentioned folded\.",
        "Before the flop, <PREV_LINE>. Assume that all other players that is not mentioned folded.",
    ),
)
_RANK_WORDS = {name.lower(): sign for sign, name in cards.RANK_NAMES.items()}
_SUIT_WORDS = {f"{name.lower()}{s}": sign for sign, name in cards.SUIT_NAMES.items() for s in ("", "s")}


def _group(text: Column, pattern: str, i: int = 1) -> Column:
    got = F.regexp_extract(text, pattern, i)
    return F.when(got != "", got)


def holding(prompt: Column) -> Column:
    """Four characters from the two cards in English; null if either is unknown."""
    word = lambda held, i: F.lower(F.regexp_extract(held, HOLDING, i))
    one = lambda held, i: F.concat(F.try_element_at(cards.lookup(_RANK_WORDS), word(held, i)), F.try_element_at(cards.lookup(_SUIT_WORDS), word(held, i + 1)))
    # The prompt is scanned once, for the two cards together.
    return let(F.regexp_extract(prompt, HOLDING, 0), lambda held: F.concat(one(held, 1), one(held, 3)))


def slots(prompt: Column) -> dict[str, Column]:
    seats = F.filter(F.transform(F.split(_group(prompt, SEATS), ","), lambda x: F.trim(x)), lambda x: x != "")
    return {
        "table_size": _group(prompt, TABLE).cast("int"),
        "small_blind_chips": _group(prompt, BLINDS, 1).cast("double"),
        "big_blind_chips": _group(prompt, BLINDS, 2).cast("double"),
        "starting_stack_chips": _group(prompt, STACK).cast("double"),
        "positions": seats,
        "slot_hero_pos": F.upper(_group(prompt, HERO)),
        "slot_hero_hole": holding(prompt),
        "pot_size_chips": _group(prompt, POT).cast("double"),
    }


def shell(prompt: Column) -> Column:
    """The prompt with its slots masked and runs of blanks made one."""
    for pattern, mask in MASKS:
        prompt = F.regexp_replace(prompt, pattern, mask)
    return F.trim(F.regexp_replace(prompt, r"\s+", " "))


def shell_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def n_slots(text: Column) -> Column:
    """Signs ``<`` plus signs ``[<``: the holding counts twice."""
    return (F.length(text) - F.length(F.replace(text, F.lit("<"), F.lit("")))) + ((F.length(text) - F.length(F.replace(text, F.lit("[<"), F.lit("")))) / 2).cast("int")


def row_id(instruction: Column) -> Column:
    return F.substring(F.sha1(instruction), 1, 16)


#: A verb of a free-text answer, with a size behind it (fixed value).
ANSWER = r"(?i)\b(fold|check|call|allin|all[\s\-]?in|raise|bet)(?:\s*(?:to\s*)?([0-9]+(?:\.[0-9]+)?)\s*(?:bb|chips)?)?"


def parse_answer(text: Column, check: Column, call: Column, raise_min: Column, raise_max: Column, allin: Column) -> Column:
    """struct<kind, amount_bb>: the first legal verb of the text.

    check, call, allin: whether they are legal; raise_min and raise_max: null if no raise is.  A call where none is legal is a check; a size is
    put into the legal range, and a missing one is the least.  Without usable verb: check if legal, else fold.
    """
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    verbs = F.regexp_extract_all(t, F.lit(ANSWER), F.lit(1))
    sizes = F.regexp_extract_all(t, F.lit(ANSWER), F.lit(2))
    can_raise = raise_min.isNotNull()
    none = F.lit(None).cast("double")

    def judged(v: Column, s: Column) -> Column:
        verb = F.regexp_replace(v, r"[ \-\n\t]", "")
        amount = F.greatest(raise_min, F.least(raise_max, F.coalesce(F.when(s != "", s).cast("double"), raise_min)))
        kind = (
            F.when(verb == "fold", "fold")
            .when((verb == "check") & check, "check")
            .when((verb == "call") & call, "call")
            .when((verb == "call") & check, "check")
            .when((verb == "allin") & allin, "allin")
            .when(verb.isin("raise", "bet") & can_raise, "raise")
        )
        return F.struct(kind.alias("kind"), F.when(kind == "raise", amount).otherwise(none).alias("amount_bb"))

    found = F.get(F.filter(F.zip_with(verbs, sizes, judged), lambda x: x["kind"].isNotNull()), F.lit(0))
    default = F.struct(F.when(check, "check").otherwise("fold").alias("kind"), none.alias("amount_bb"))
    return F.coalesce(found, default)


def first_action(text: Column) -> Column:
    """The first action word of a model's answer without blanks and hyphens; else its first line, lower-cased."""
    got = F.regexp_extract(text, r"(?i)\b(fold|check|call|all[\s-]?in|raise|bet)\b", 1)
    line = F.lower(F.trim(F.get(F.split(F.trim(text), "\n"), F.lit(0))))
    return F.when(got != "", F.lower(F.regexp_replace(got, r"[\s-]", ""))).otherwise(line)


def keyword_decision(text: Column, words: tuple[str, ...] = ("fold", "check", "call", "raise", "bet", "allin")) -> Column:
    """The first of the words, in the list's order, that the text holds; ``unknown`` if none."""
    out = F.lit("unknown")
    for w in reversed(words):
        out = F.when(F.contains(F.lower(text), F.lit(w)), w).otherwise(out)
    return out


def format_action(action: Column, amount: Column) -> Column:
    """``raise 8.5bb``; other actions bare."""
    return F.when((action == "raise") & amount.isNotNull(), F.concat(F.lit("raise "), lines.format_g(amount), F.lit("bb"))).otherwise(action)


def action_line(label: Column) -> Column:
    """``FOLD``, ``RAISE 8.0 BB``, ``ALLIN`` (also for a sized jam or shove); empty is ``CHECK``; anything else upper-cased."""
    t = F.trim(F.coalesce(label, F.lit("")))
    low = F.lower(t)
    sized = r"^(raise|bet|jam|shove)\s*([0-9]+(?:\.[0-9]+)?)"
    verb, size = F.regexp_extract(low, sized, 1), F.regexp_extract(low, sized, 2)
    return (
        F.when(t == "", "CHECK")
        .when(low.isin("all-in", "all in") | verb.isin("jam", "shove"), "ALLIN")
        .when(verb != "", F.concat(F.upper(verb), F.lit(" "), size, F.lit(" BB")))
        .otherwise(F.upper(t))
    )


def _upto_last(text: Column, line: str, with_it: int) -> Column:
    """What stands before the last line that matches (``with_it`` 1: with that line), without white space at its end; null if no line does."""
    rows = F.split(text, "\n")
    back = F.array_position(F.reverse(F.transform(rows, lambda r: F.rlike(r, F.lit(line)))), True).cast("int")
    kept = F.array_join(F.slice(rows, 1, F.greatest(F.size(rows) - back + with_it, F.lit(0))), "\n")
    return F.when(back > 0, F.regexp_replace(kept, r"\s+$", ""))


def enforce_decision(text: Column, gold: Column) -> Column:
    """All that follows the last ``Decision:`` line, and that line, replaced by the gold decision; or one added."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+$", "")
    return F.concat(F.coalesce(_upto_last(body, r"(?i)^\s*decision\s*:.*$", 0), body), F.lit("\nDecision: "), F.trim(gold))


def enforce_structured(text: Column, gold: Column) -> Column:
    """The same for the block under the last ``### Action`` header."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+$", "")
    head = _upto_last(body, r"(?i)^\s*#{2,4}\s*action\s*$", 1)
    return F.concat(F.coalesce(head, F.concat(body, F.lit("\n\n### Action"))), F.lit("\n"), action_line(gold))


def labeler_prompt(instruction: Column, gold: Column) -> Column:
    """What a labeler is asked: the situation, the solver's action, and how to end."""
    g = F.trim(gold)
    return F.concat(F.lit("Situation:\n"), F.trim(instruction), F.lit("\n\nGold action (from the solver): "), g, F.lit("\n\nWrite the reasoning trace, ending with 'Decision: "), g, F.lit("'."))


def student_content(reasoning: Column, action: Column, structured: bool = False) -> Column:
    """The assistant's text: a structured one as it is, a concise one with its decision line."""
    return reasoning if structured else F.concat(F.trim(reasoning), F.lit("\nDecision: "), F.trim(action))


def messages(system: Column, user: Column, assistant: Column) -> Column:
    """array<struct<role, content>> of the three, blanks at the ends cut off."""
    one = lambda role, text: F.struct(F.lit(role).alias("role"), F.trim(text).alias("content"))
    return F.array(one("system", system), one("user", user), one("assistant", assistant))
