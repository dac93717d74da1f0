"""All registered queries of the reference's operators: name -> query, and name -> oracle SQL."""

from __future__ import annotations

from . import container_queries, sequence_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES  # noqa: F401
