"""Column functions: cards, action lines, labels, prompts, scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value worked out once, however often ``f`` uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))
