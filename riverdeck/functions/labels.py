"""Decision labels in their raw, canonical and older forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SIZED = r"^[0-9]+(\.[0-9]+)?\s*bb$"


def canonical(label: Column) -> Column:
    """fold, check, call, allin or raise; null for anything else."""
    t = F.lower(F.trim(label))
    return (
        F.when(t.startswith("fold"), "fold")
        .when(t.startswith("check"), "check")
        .when(t.startswith("call"), "call")
        .when(t.startswith("allin") | F.contains(t, F.lit("all-in")) | F.contains(t, F.lit("all in")), "allin")
        .when(t.startswith("bet") | t.startswith("raise") | F.rlike(t, F.lit(_SIZED)), "raise")
    )


def canonical_or_unknown(label: Column) -> Column:
    """The older rule: ``all-in`` only in front, and ``unknown`` for the rest."""
    t = F.lower(F.trim(label))
    return F.coalesce(
        F.when(t.startswith("fold"), "fold")
        .when(t.startswith("check"), "check")
        .when(t.startswith("call"), "call")
        .when(t.startswith("allin") | t.startswith("all-in") | t.startswith("all in"), "allin")
        .when(t.startswith("bet") | t.startswith("raise") | F.rlike(t, F.lit(_SIZED)), "raise"),
        F.lit("unknown"),
    )


def bet_size(label: Column) -> Column:
    """The number before ``b`` or ``bb``, else the one after a leading raise or bet."""
    one = F.regexp_extract(label, r"(?i)([0-9]+(?:\.[0-9]+)?)\s*bb?\b", 1)
    two = F.regexp_extract(label, r"(?i)^\s*(?:raise|bet)\s+([0-9]+(?:\.[0-9]+)?)", 1)
    return F.coalesce(F.when(one != "", one), F.when(two != "", two)).cast("double")


def position_category(position: Column) -> Column:
    p = F.upper(position)
    return F.when(p.isin("UTG", "UTG+1"), "early").when(p.isin("MP", "HJ", "LJ"), "middle").when(p.isin("CO", "BTN"), "late").when(p.isin("SB", "BB"), "blinds")


def moves(text: Column, fallback: str = "split") -> Column:
    """The array that a list literal (``['fold', 'call']``) stands for.

    What is no such list is cut at commas, blanks dropped (``split``), or taken as one move (``whole``).
    """
    t = F.trim(text)
    parsed = F.from_json(F.when(F.rlike(t, F.lit(r"^\[.*\]$")), F.translate(t, "'", '"')), "array<string>")
    cut = F.filter(F.transform(F.split(t, ","), lambda x: F.trim(x)), lambda x: x != "")
    other = cut if fallback == "split" else F.array(t)
    return F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).otherwise(F.coalesce(parsed, other))
