"""All registered queries outside the training-data operators, with their SQL."""

from __future__ import annotations

from .plans import evaluation, learning, pieces, records, scenario, streams, trajectory  # noqa: F401  (they register their queries)
from .plans.registry import ORACLES, QUERIES

FLAGSHIP = "prj_situation"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
